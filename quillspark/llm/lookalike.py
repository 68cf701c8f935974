"""Problem 5: visually identical text with different characters.

Method: script-aware repair. Marks, spaces, full-width forms and compositions are unified for every
text. Letters of other scripts that look like Latin ones (or the other way round) are looked at
token by token: the dominant script of the token is determined, and look-alikes are substituted only
if the repaired token occurs in the vocabulary of the corpus. Tokens of a single foreign script that
consist of look-alikes only are repaired by the same test, but only in texts that hold no letter
proper to that script, so that genuine Russian or Greek stays as it is.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fold import CYRILLIC, GREEK, has_foreign, unify_marks
from .near_dup import text_key

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"[{_LATIN}Ͱ-ϿЀ-ӿԀ-ԯ]+")
_LATIN_WORD = re.compile(f"[{_LATIN}]+")
_PROPER = {
    "cyrillic": re.compile("[" + "".join(chr(c) for c in range(0x400, 0x530) if chr(c).isalpha() and chr(c) not in CYRILLIC) + "]"),
    "greek": re.compile("[" + "".join(chr(c) for c in range(0x370, 0x400) if chr(c).isalpha() and chr(c) not in GREEK) + "]"),
}
_TO_LATIN = str.maketrans({**CYRILLIC, **GREEK})
_FROM_LATIN = {"cyrillic": str.maketrans({v: k for k, v in CYRILLIC.items()}), "greek": str.maketrans({v: k for k, v in GREEK.items()})}


def script(c: str) -> str:
    """latin, greek or cyrillic of a letter of these."""
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def repaired(token: str, text: str) -> str | None:
    """The form that a token of `text` should have if that occurs in the corpus; None to leave it."""
    scripts = [script(c) for c in token]
    kinds = set(scripts)
    if kinds == {"latin"}:
        return None
    own = {k for k in kinds if k != "latin" and _PROPER[k].search(token)}
    if not own:  # every foreign letter looks like a Latin one
        if "latin" not in kinds and any(_PROPER[k].search(text) for k in kinds):
            return None
        return token.translate(_TO_LATIN)
    main = max(sorted(own), key=scripts.count)
    if kinds != {"latin", main} or scripts.count(main) < scripts.count("latin"):
        return None
    out = token.translate(_FROM_LATIN[main])
    return out if all(script(c) == main for c in out) else None


def apply_repairs(text: str, known: set[str]) -> str:
    """The text with those of its tokens repaired whose repaired form is known."""

    def one(m: re.Match) -> str:
        r = repaired(m.group(), text)
        return r if r is not None and r in known else m.group()

    return _WORD.sub(one, text)


def unified(values: DataFrame) -> DataFrame:
    """(field_name, id, stored_key, unified_key, unified) of (field_name, id, value), the keys of 128 bits.

    unified is null where it equals the stored value. Null values and ids are left out; an empty
    value stays empty. Rows that repeat are returned once.
    """

    def run(it):
        seen: set[str] = set()
        for batch in it:
            out: list[tuple] = []
            for f, i, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                m = unify_marks(v)
                sk = text_key(v)
                if m.isascii() or not has_foreign(m):
                    mk = sk if m is v or m == v else text_key(m)
                    out.append((0, f, i, sk, mk, None if mk == sk else m, None))
                    words = _LATIN_WORD.findall(m)
                else:
                    out.append((1, f, i, sk, None, m, sorted({r for w in set(_WORD.findall(m)) if (r := repaired(w, m)) is not None})))
                    words = [w for w in _WORD.findall(m) if len({script(c) for c in w}) == 1]
                new = set(words) - seen
                out += [(2, None, None, None, None, w, None) for w in new]
                seen |= new
                if len(seen) > 1_000_000:  # bounded memory; a word sent twice is no error
                    seen.clear()
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "field_name", "id", "stored_key", "unified_key", "unified", "wanted"])

    from ..session import materialize

    src = values.where("value is not null and id is not null").select("field_name", "id", "value")
    rows = materialize(src.mapInArrow(run, "kind int, field_name string, id string, stored_key binary, unified_key binary, unified string, wanted array<string>"), "unified")

    def repair(it):
        for batch in it:
            out = [apply_repairs(t, set(k or ())) for t, k in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([text_key(t) for t in out], pa.binary()), pa.array(out, pa.string())], names=["field_name", "id", "stored_key", "unified_key", "unified"])

    foreign = rows.where("kind = 1").select("field_name", "id", "stored_key", "unified", "wanted").distinct()
    wanted = foreign.select("field_name", "id", "stored_key", F.explode("wanted").alias("word"))
    known = rows.where("kind = 2").select(F.col("unified").alias("word")).join(wanted.select("word").distinct(), "word", "left_semi").distinct()
    # a row's own words only: bounded by the row
    mine = wanted.join(known, "word").groupBy("field_name", "id", "stored_key").agg(F.collect_set("word").alias("known"))
    fixed = foreign.drop("wanted").join(mine, ["field_name", "id", "stored_key"], "left").select("field_name", "id", "stored_key", "unified", "known").mapInArrow(repair, "field_name string, id string, stored_key binary, unified_key binary, unified string")
    return rows.where("kind = 0").select("field_name", "id", "stored_key", "unified_key", "unified").dropDuplicates(["field_name", "id", "stored_key"]).union(fixed)


def fields(chunks: DataFrame) -> DataFrame:
    """(field_name, id, value): chunk texts, and the project names of documents in chunk metadata."""
    texts = chunks.select(F.lit("text").alias("field_name"), F.col("chunk_id").alias("id"), F.col("text").alias("value"))
    names = chunks.select(F.lit("project_name").alias("field_name"), F.col("doc_id").alias("id"), F.col("metadata")["project_name"].alias("value")).distinct()
    return texts.union(names)


def found(chunks: DataFrame) -> DataFrame:
    """(field_name, id_a, id_b): values that read the same and are stored differently."""
    from ..session import materialize

    u = materialize(unified(fields(chunks)).select("field_name", "id", "stored_key", "unified_key"), "forms")
    forms = u.groupBy("field_name", "unified_key").agg(F.min("stored_key").alias("x"), F.max("stored_key").alias("y")).where("x <> y").select("field_name", "unified_key")
    u = u.join(forms, ["field_name", "unified_key"], "left_semi")
    a, b = u.alias("a"), u.alias("b")
    pairs = a.join(b, (F.col("a.field_name") == F.col("b.field_name")) & (F.col("a.unified_key") == F.col("b.unified_key")) & (F.col("a.stored_key") != F.col("b.stored_key")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.field_name").alias("field_name"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
