"""External models behind an interface: retries and rotation, a deterministic stub, calls from DataFrames."""

from __future__ import annotations

import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import markdown as M
from quire.operators.lookup import bounded

TRIES = 2
# Seconds before the next try, and the patient rounds (tries, seconds) while a service is overloaded.
SKIP_DELAY, RATE_DELAY, OVERLOAD_DELAY, STEP_DELAY = 2, 10, 30, 5
PATIENCE = ((10, 60), (20, 180))


class ProviderError(Exception):
    def __init__(self, message: str, kind: str = "other"):
        super().__init__(message)
        self.kind = kind  # rate, overload, persistent or other


class Provider(ABC):
    #: Seconds between two calls for one document.
    delay = 0.0

    @abstractmethod
    def call(self, model: str, prompt: str) -> str: ...

    def call_bytes(self, model: str, data: bytes, prompt: str) -> str:
        """The answer to a file with a prompt."""
        raise ProviderError(f"{model} takes no files", "persistent")

    def prompt_capable(self, model: str) -> bool:
        """Whether a model follows prompts; one that reads pages only doesn't."""
        return True

    def prefers_full_document(self, model: str) -> bool:
        return False


class EchoProvider(Provider):
    """Offline and deterministic: the text after the prompt's last marker, tagged with the model; what is to be translated begins at the first and may hold more."""

    def call(self, model: str, prompt: str) -> str:
        return f"[{model}] " + (prompt.split("\n---\n", 1)[-1] if prompt.startswith("Translate ") else prompt.rpartition("\n---\n")[2])


class PageProvider(Provider):
    """Offline and deterministic: pages come back as they are, a scan gives their headings."""

    def call(self, model: str, prompt: str) -> str:
        pages = prompt.rpartition("\n---\n")[2]
        return "\n".join(x for x in pages.split("\n") if x.startswith("#") or x.startswith("NOTE STYLE:")) if prompt.startswith("Outline:") else pages


class ReaderProvider(Provider):
    """Offline: a model that reads pages only refuses text calls for good, so the rotation moves on; others echo."""

    def __init__(self, reads_only: str = r"(?i)^mistral-ocr"):
        self.reads_only = reads_only

    def prompt_capable(self, model: str) -> bool:
        return re.search(self.reads_only, model) is None

    def prefers_full_document(self, model: str) -> bool:
        return not self.prompt_capable(model)

    def call(self, model: str, prompt: str) -> str:
        if not self.prompt_capable(model):
            raise ProviderError(f"{model} reads pages and can't be asked", "persistent")
        return EchoProvider().call(model, prompt)

    def call_bytes(self, model: str, data: bytes, prompt: str) -> str:
        return data.decode("utf-8", "replace")


_PROVIDERS: dict[str, Callable[[], Provider]] = {"echo": EchoProvider, "pages": PageProvider, "reader": ReaderProvider}


def register(name: str, make: Callable[[], Provider]) -> None:
    _PROVIDERS[name] = make


def provider(name: str) -> Provider:
    return _PROVIDERS[name]()


def call(p: Provider, models: list[str], prompt: str, skip: set[str] | None = None, wait: Callable[[float], None] = time.sleep) -> tuple[str, str, list[float]]:
    """(answer, model, waits): two tries a model in rotation, then patience if the last failure was an overload.

    The models are fixed when the call begins: one that lands on the skip list is left out of later calls only.
    """
    skip = set() if skip is None else skip
    usable = [m for m in models if m not in skip]
    if not usable:
        raise ProviderError("every model was skipped", "persistent")
    waits: list[float] = []
    limited: set[str] = set()
    total = TRIES * len(usable)
    error: ProviderError | None = None

    def pause(seconds: float) -> None:
        waits.append(seconds)
        wait(seconds)

    for k in range(total):
        model = usable[k // TRIES % len(usable)]
        try:
            return p.call(model, prompt), model, waits
        except ProviderError as e:
            error = e
            again = e.kind == "rate" and model in limited
            limited |= {model} if e.kind == "rate" else set()
            gone = e.kind == "persistent" or again
            skip |= {model} if gone else set()
            if k + 1 < total:
                pause(SKIP_DELAY if gone else RATE_DELAY if e.kind == "rate" else OVERLOAD_DELAY if e.kind == "overload" else STEP_DELAY * (k + 1))
    for tries, seconds in PATIENCE if error is not None and error.kind == "overload" else ():
        for k in range(tries):
            pause(seconds)
            try:
                model = usable[k % len(usable)]
                return p.call(model, prompt), model, waits
            except ProviderError as e:
                error = e
                if e.kind != "overload":
                    raise
    raise error or ProviderError("no model")


def _translated(p: Provider, models: list[str], language: str, text: str, skip: set[str]) -> str:
    return M.strip_fence(call(p, models, f"Translate to {language}.\n---\n{text}", skip)[0])


def translate(chunks: DataFrame, language: str, models: list[str], name: str = "echo") -> DataFrame:
    """(doc_id, text): chunks translated independently, in parallel, and joined by blank lines in order."""

    def run(texts: pd.Series) -> pd.Series:
        p, skip = provider(name), set()
        return pd.Series([_translated(p, models, language, t, skip) for t in texts], dtype=object)

    done = bounded(chunks).withColumn("text", F.pandas_udf(run, "string").asNondeterministic()("text"))  # so that no call is made twice
    rows = F.sort_array(F.collect_list(F.struct("chunk_no", "text")))
    return done.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"))


def translate_documents(docs: DataFrame, language: str, models: list[str], name: str = "echo", most: float = M.TRANSLATE_WORDS) -> DataFrame:
    """(doc_id, text): each row's text translated in chunks of about so many words, joined by blank lines; null stays null.

    A row is a document: nothing is grouped, so rows that share an id, or have none, stay apart.
    """

    def run(texts: pd.Series) -> pd.Series:
        p, skip = provider(name), set()
        return pd.Series([None if t is None else "\n\n".join(_translated(p, models, language, x, skip) for x in M.translate_chunks(t, most)) for t in texts], dtype=object)

    return bounded(docs).select("doc_id", F.pandas_udf(run, "string").asNondeterministic()("text").alias("text"))
