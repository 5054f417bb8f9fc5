"""The settings that a corpus was built under, as a string that must not change under it."""

from __future__ import annotations

from dataclasses import dataclass

from caseweave.errors import ConfigError


def escape(value: object) -> str:
    """A value that can't be taken for a separator: backslash, bar and what does not print as \\xNN."""
    return "".join(c if c.isprintable() and c not in "\\|" else "".join(f"\\x{b:02x}" for b in c.encode()) for c in str(value))


@dataclass(frozen=True)
class Contract:
    """How texts are cut and embedded."""

    chunk_max_chars: int = 2000
    chunk_overlap_chars: int = 200
    embedder: str = "deterministic"
    dimensions: int = 256
    summariser: str = ""
    embed_library: str = ""

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap_chars < self.chunk_max_chars or self.dimensions < 1:
            raise ConfigError("the overlap must be smaller than the window, and vectors need a width")

    def identity(self) -> str:
        """``k=v`` pairs joined by bars; a summariser and a library are named only if there is one."""
        fields = {k: v for k, v in self.__dict__.items() if k not in ("summariser", "embed_library") or v}
        return "|".join(f"{k}={escape(v)}" for k, v in fields.items())


def verify(recorded: str | None, contract: Contract) -> None:
    """A store keeps to the contract that it was made under."""
    if recorded is not None and recorded != contract.identity():
        raise ConfigError(f"this store was made under {recorded!r}, not {contract.identity()!r}")
