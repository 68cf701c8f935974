"""Interfaces to what lives outside of Spark: parsers of documents, models, recognisers of text.

Each is a small protocol; the library ships stand-ins that need no network, and document libraries are
used only where they are installed.
"""

from __future__ import annotations

import hashlib
import io
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


# Fixed value: the answer where the search has found nothing.
NOTHING_FOUND = "관련 문서 내용을 찾지 못했습니다. 원본 문서나 검색 조건을 다시 확인해 주세요."


class DocumentParser(Protocol):
    """Bytes of a file to its text."""

    def __call__(self, content: bytes) -> str: ...


class Embedder(Protocol):
    """Texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class AnswerModel(Protocol):
    """Prompts to answers."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def pdf_text(content: bytes) -> str:
    """Page texts of a PDF file joined by blank lines; needs pypdf."""
    from pypdf import PdfReader

    return "\n\n".join((p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages).strip()


def hwp_text(content: bytes) -> str:
    """The text of an HWP file; needs olefile."""
    from . import hwp

    return "\n".join(p if isinstance(p, str) else "\n".join(x for c in p.cells for x in c.text) for s in hwp.body_streams(content) for p in hwp.content(s))


def plain_text(content: bytes) -> str:
    return content.decode("utf-8-sig").strip()


PARSERS: dict[str, DocumentParser] = {"txt": plain_text, "md": plain_text, "pdf": pdf_text, "hwp": hwp_text}


def parse_documents(files: DataFrame, parsers: dict[str, DocumentParser] | None = None) -> DataFrame:
    """(path, text, error) of (path, content): each file by the parser of its suffix. An unknown suffix, a
    missing library and a broken file each give an error row."""
    known = parsers or PARSERS

    def one(path: str, content: bytes):
        suffix = path.rpartition(".")[2].lower()
        try:
            if suffix not in known:
                raise ValueError(f"no parser for .{suffix}")
            return known[suffix](content), None
        except Exception as e:  # noqa: BLE001 - each document fails for itself
            return None, f"{type(e).__name__}: {e}"

    def run(it):
        for b in it:
            out = [one(p, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def hash_embedder(size: int = 64) -> Embedder:
    """A stand-in for a model: word and letter-triple counts hashed to a unit vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            s = " ".join((t or "").lower().split())
            for g in [*s.split(" "), *(s[j : j + 3] for j in range(len(s) - 2))]:
                h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                out[i, h % size] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    return embed


def term_embedder(size: int = 64) -> Embedder:
    """A stand-in for a model: term counts hashed to the whole-number places of a vector, some of them negative."""
    import re

    place: dict[str, tuple[int, int]] = {}

    def of(term: str) -> tuple[int, int]:
        if term not in place:
            if len(place) > 1_000_000:
                place.clear()
            h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
            place[term] = h % size, 1 if h >> 31 else -1
        return place[term]

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            row = [0] * size
            for w in " ".join(re.findall("[0-9A-Za-z가-힣]+", t or "")).lower().split():
                d, sign = place[w] if w in place else of(w)
                row[d] += sign
            out[i] = row
        return out

    return embed


def embed_column(df: DataFrame, text: str = "text", embedder: Embedder | None = None, out: str = "vector") -> DataFrame:
    """df with the vectors of a text column, batch by batch."""
    model = embedder or hash_embedder()
    names = df.columns
    schema = df.withColumn(out, F.array().cast("array<float>")).schema

    def run(it):
        for b in it:
            v = model(b.column(names.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v), pa.list_(pa.float32()))], names=[*names, out])

    return df.mapInArrow(run, schema)


def answer(df: DataFrame, model: AnswerModel, prompt: str = "prompt", context: str = "context", nothing: str = NOTHING_FOUND) -> DataFrame:
    """df with `answer`: the model's, or the fixed answer where the context is blank, without a call."""
    names = df.columns
    schema = df.withColumn("answer", F.lit("")).schema

    def run(it):
        for b in it:
            p, c = b.column(names.index(prompt)).to_pylist(), b.column(names.index(context)).to_pylist()
            ask = [i for i, x in enumerate(c) if x and x.strip()]
            got = dict(zip(ask, model([p[i] for i in ask]) if ask else []))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([got.get(i, nothing) for i in range(len(p))], pa.string())], names=[*names, "answer"])

    return df.mapInArrow(run, schema)


class ToolModel(Protocol):
    """A conversation to (text, calls): calls are (tool, argument); without any, the text is the answer."""

    def __call__(self, messages: list[str]) -> tuple[str, list[tuple[str, str]]]: ...


def answer_with_tools(df: DataFrame, model: ToolModel, tools: dict, prompt: str = "prompt", context: str = "context", nothing: str = NOTHING_FOUND) -> DataFrame:
    """df with `answer`: the model may ask for tools once; their results go back to it, and what it then says
    is the answer. An unknown tool gives an error text as its result. Blank contexts give the fixed answer
    without a call."""
    names = df.columns
    schema = df.withColumn("answer", F.lit("")).schema

    def one(p: str, c: str | None) -> str:
        if not c or not c.strip():
            return nothing
        text, calls = model([p])
        if not calls:
            return text
        results = [str(tools[t](x)) if t in tools else f"오류: 알 수 없는 도구 호출 - {t}" for t, x in calls]
        return model([p, text, *results])[0]

    def run(it):
        for b in it:
            out = [one(p, c) for p, c in zip(b.column(names.index(prompt)).to_pylist(), b.column(names.index(context)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, "answer"])

    return df.mapInArrow(run, schema)


def condense(df: DataFrame, model: AnswerModel, question: str = "question", history: str = "history") -> DataFrame:
    """df with `standalone`: the question as it is without history (array<struct<question,answer>>), else as the
    model rewrites it with the turns before it."""
    names = df.columns
    schema = df.withColumn("standalone", F.lit("")).schema

    def run(it):
        for b in it:
            q, h = b.column(names.index(question)).to_pylist(), b.column(names.index(history)).to_pylist()
            ask = [i for i, x in enumerate(h) if x]
            prompts = ["\n".join([*(f"Q: {t['question']}\nA: {t['answer']}" for t in h[i]), f"Q: {q[i]}"]) for i in ask]
            got = dict(zip(ask, model(prompts) if ask else []))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([got.get(i, x) for i, x in enumerate(q)], pa.string())], names=[*names, "standalone"])

    return df.mapInArrow(run, schema)


def call_settings(model: str, settings: dict, fixed_sampling: tuple[str, ...] = ("gpt-5", "o1", "o3", "o4")) -> dict:
    """The parameters of a call: models whose sampling is fixed take an effort in place of temperature and top_p."""
    keys = ("reasoning_effort",) if model.startswith(fixed_sampling) else ("temperature", "top_p")
    return {"model": model, "max_tokens": settings["max_tokens"], **{k: settings[k] for k in keys}}
