"""Identifiers in text: email addresses, phone numbers, bank accounts, registration numbers.

A finder gives (value, normalised, start, end) for what it recognises in a
text, offsets in code points. Patterns have bounded quantifiers, so that text
written to make them backtrack can't.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# The patterns and limits of the four kinds.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,12}[A-Za-z]{2,24}"
PHONE = r"\+[0-9]{1,3}(?:[0-9]{5,14}|(?:[ .\-" + "\u00a0" + r"]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){1,7})"
IBAN = r"\b[A-Za-z]{2}[0-9]{2}(?:[ \t" + "\u00a0" + r"]?[A-Za-z0-9]){11,30}\b"
KEYWORDS = "ЄДРПОУ|ЕДРПОУ|ІПН|ИНН|EDRPOU"
NUMBER = r"(?<![0-9])[0-9]{8,12}(?![0-9])"
PHONE_DIGITS = (8, 15)
IBAN_LEAST = 15
KEYWORD_REACH = 40

Found = tuple[str, str, int, int]


def emails(text: str) -> list[Found]:
    return [(m.group(), m.group().lower(), *m.span()) for m in re.finditer(EMAIL, text)]


def phones(text: str) -> list[Found]:
    out = []
    for m in re.finditer(PHONE, text):
        digits = "".join(c for c in m.group() if c in "0123456789")
        if PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1]:
            out.append((m.group(), "+" + digits, *m.span()))
    return out


def check_digits_hold(account: str) -> bool:
    """ISO 7064 mod 97-10 over an upper-case account: its first four characters go last, letters count from 10."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str) -> list[Found]:
    """Accounts whose check digits hold.

    A candidate may run on into following words, so groups between white space
    are given back from its end until the check digits hold. One that never
    holds may still hide an account that begins inside it.
    """
    out, pattern, at = [], re.compile(IBAN), 0
    while found := pattern.search(text, at):
        start = found.start()
        ends = [start + m.end() for m in re.finditer(r"\S+", found.group())]
        for end in reversed(ends):
            account = "".join(text[start:end].split()).upper()
            if len(account) < IBAN_LEAST:
                end = -1
                break
            if check_digits_hold(account):
                out.append((text[start:end], account, start, end))
                break
        else:
            end = -1
        at = end if end > 0 else start + 1
    return out


def registration_numbers(text: str) -> list[Found]:
    """Numbers that the nearest keyword before them names: within reach, with no digit between."""
    keyword, out = re.compile(KEYWORDS, re.IGNORECASE), []
    for m in re.finditer(NUMBER, text):
        start = m.start()
        reach = text[max(0, start - KEYWORD_REACH) : start]
        named = [k.end() for k in keyword.finditer(reach)]
        if named and not reach.endswith("+") and not re.search("[0-9]", reach[named[-1] :]):
            out.append((m.group(), m.group(), start, m.end()))
    return out


#: Finders by kind, in the order in which kinds are listed.
FINDERS: dict[str, Callable[[str], list[Found]]] = {"email": emails, "phone": phones, "iban": ibans, "registration_number": registration_numbers}
KINDS = tuple(FINDERS)


def normalise(value: str, kind: str = "") -> str:
    """A caller's value as it is stored: the normalised form of a finder that recognises all of it, else as it is."""
    for name, find in FINDERS.items():
        if kind in ("", name):
            for whole, normal, _, _ in find(value):
                if whole == value.strip():
                    return normal
    return value
