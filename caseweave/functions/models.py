"""Models behind the ports, and how a configuration chooses them.

A model embedder and a cross-encoder run ONNX files with the tokenizer beside
them; a summariser asks a chat endpoint. All load where they are used: an
instance that is sent to executors holds paths and settings alone.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from importlib import metadata

import numpy as np

from caseweave.errors import ConfigError, RerankUnavailable
from caseweave.functions.embedding import Embedder, HashEmbedder
from caseweave.functions.enrich import DOCUMENT_CHARS, Reranker, Summariser
from caseweave.identity import Contract

# What an e5 model wants before a text, and tokens it reads.
PASSAGE, QUERY = "passage: ", "query: "
TOKENS_MOST, BATCH = 512, 32
LIBRARY = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:==)\s*([A-Za-z0-9][A-Za-z0-9.!+_-]*)\s*")


class Onnx:
    """An ONNX model and its tokenizer in a folder, loaded at first use and never sent along."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __getstate__(self) -> dict:
        return {"folder": self.folder}

    def load(self) -> None:
        if hasattr(self, "session"):
            return
        model, words = os.path.join(self.folder, "model.onnx"), os.path.join(self.folder, "tokenizer.json")
        if not os.path.isfile(model) or not os.path.isfile(words):
            raise ConfigError(f"{self.folder} needs model.onnx and tokenizer.json")
        try:
            import onnxruntime
            import tokenizers
        except ImportError as e:
            raise ConfigError("running a model needs onnxruntime and tokenizers") from e
        self.tokenizer = tokenizers.Tokenizer.from_file(words)
        self.tokenizer.enable_truncation(TOKENS_MOST)
        self.tokenizer.enable_padding()
        self.session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])

    def run(self, batch: list) -> tuple[np.ndarray, np.ndarray]:
        """(first output, attention mask) of a batch of texts or pairs of texts."""
        self.load()
        coded = self.tokenizer.encode_batch(batch)
        given = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
        wanted = {i.name for i in self.session.get_inputs()}
        return self.session.run(None, {k: np.array(v, np.int64) for k, v in given.items() if k in wanted})[0], np.array(given["attention_mask"])


class ModelEmbedder:
    """Unit vectors by mean pooling of an e5 model; the model's width must be the one declared."""

    def __init__(self, folder: str, dimensions: int, name: str = "e5") -> None:
        self.model, self.dimensions, self.name = Onnx(folder), dimensions, name

    def _vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for at in range(0, len(texts), BATCH):
            states, mask = self.model.run(texts[at : at + BATCH])
            v = (states * mask[:, :, None]).sum(axis=1) / np.maximum(1, mask.sum(axis=1, keepdims=True))
            if v.shape[1] != self.dimensions:
                raise ConfigError(f"the model gives vectors of {v.shape[1]}, the contract says {self.dimensions}")
            out[at : at + BATCH] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return out

    def documents(self, texts: list[str]) -> np.ndarray:
        return self._vectors([PASSAGE + t for t in texts])

    def query(self, text: str) -> np.ndarray:
        return self._vectors([QUERY + text])[0]


class CrossEncoder:
    """A reranker that reads query and passage together; one that can't be loaded is unavailable, wrong settings are not."""

    def __init__(self, folder: str, name: str = "cross-encoder") -> None:
        self.model, self.name = Onnx(folder), name

    def scores(self, query: str, texts: list[str]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(texts), BATCH):
            try:
                logits, _ = self.model.run([(query, t) for t in texts[at : at + BATCH]])
            except ConfigError:
                raise
            except Exception as e:
                raise RerankUnavailable(f"{self.name}: {e}") from e
            out += np.asarray(logits).reshape(len(logits), -1)[:, -1].tolist()
        return out


class ChatSummariser:
    """Summaries by a chat endpoint, several passages at once, in their order."""

    def __init__(self, url: str, model: str, concurrency: int = 8, seconds: int = 120) -> None:
        self.url, self.model, self.concurrency, self.seconds, self.name = url, model, concurrency, seconds, model

    def ask(self, instruction: str, text: str) -> str:
        body = json.dumps({"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": instruction}, {"role": "user", "content": text}]}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.seconds) as f:
            return json.load(f)["choices"][0]["message"]["content"].strip()

    def passages(self, document: str, texts: list[str]) -> list[str]:
        instruction = "Say in one sentence what the passage adds to the document it is from. Answer in the passage's language.\n\nThe document:\n" + document[:DOCUMENT_CHARS]
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(lambda t: self.ask(instruction, t), texts))

    def document(self, notes: str) -> str:
        return self.ask("Summarise the document that these numbered notes are on, in three sentences.", notes[:DOCUMENT_CHARS])


# --- libraries -----------------------------------------------------------------------------------


def canonical_library(declared: str) -> tuple[str, str] | None:
    """(distribution, version) of ``name==version``, names in one spelling; None of anything else."""
    found = LIBRARY.fullmatch(declared)
    return (re.sub(r"[-_.]+", "-", found[1]).lower(), found[2]) if found else None


def same_release(a: str, b: str) -> bool:
    """Whether two versions are one release: local parts and trailing zeros aside."""
    plain = lambda v: re.sub(r"(\.0+)+$", "", v.split("+")[0].lower())
    return plain(a) == plain(b)


def library_mismatch(declared: str, version_of=metadata.version) -> str:
    """How the library that a contract names differs from what is installed; empty if it doesn't."""
    parsed = canonical_library(declared)
    if parsed is None:
        return f"{declared!r} is not name==version"
    try:
        installed = version_of(parsed[0])
    except metadata.PackageNotFoundError:
        return f"the contract names {declared!r}, and {parsed[0]} is not installed"
    if installed is None:
        return f"the version of {parsed[0]} can't be told; repair its installation and leave the contract as it is"
    return "" if same_release(installed, parsed[1]) else f"the contract names {declared!r}, and {parsed[0]} {installed} is installed"


def running_mismatch(declared: str, module) -> str:
    """How the library that a contract names differs from the module that runs."""
    parsed, running = canonical_library(declared), getattr(module, "__version__", None)
    if parsed is None:
        return f"{declared!r} is not name==version"
    if running is None:
        return f"{module.__name__} doesn't say its version"
    return "" if same_release(running, parsed[1]) else f"the contract names {declared!r}, and {module.__name__} {running} runs"


# --- choosing ------------------------------------------------------------------------------------


def build_embedder(contract: Contract, folder: str = "") -> Embedder:
    """The embedder that a contract names: the deterministic one, or a model in ``folder``."""
    if contract.embedder == "deterministic":
        return HashEmbedder(contract.dimensions)
    if not folder:
        raise ConfigError(f"the embedder {contract.embedder!r} needs a folder with its model")
    if contract.embed_library:
        import onnxruntime

        if said := library_mismatch(contract.embed_library) or running_mismatch(contract.embed_library, onnxruntime):
            raise ConfigError(said)
    return ModelEmbedder(folder, contract.dimensions, contract.embedder)


def build_reranker(folder: str = "") -> Reranker | None:
    return CrossEncoder(folder) if folder else None


def build_summariser(contract: Contract, url: str = "", concurrency: int = 8) -> Summariser | None:
    """The summariser that a contract names, or none; one without an endpoint is an error."""
    if not contract.summariser:
        return None
    if not url:
        raise ConfigError(f"the summariser {contract.summariser!r} needs an endpoint")
    return ChatSummariser(url, contract.summariser, concurrency)
