"""Problem 7: broken prompt and response pairs.

Method: the distinct responses are sorted by text over ranges, and each is compared with its
neighbour: a response that is a proper prefix of the next one is a shortened version of it. Lengths
at which responses pile up show a length limit. Rules for copies, refusals and languages follow; the
first defect that applies is reported.
"""

from __future__ import annotations

import re
import unicodedata
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .fold import unify

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
# Words that open a list of sources, or label an answer or a question.
_SOURCES = re.compile(r"(?:^|\n)\s*(?:참고한?\s*(?:문서|자료|문헌)|근거\s*(?:문서|자료)|출처|sources?|references?)\s*[:：].*\Z", re.I | re.S)
_LABEL = re.compile(r"^\s*(?:답변|답|응답|정답|answer|response|a|질문|문의|question|q)\s*[:：]\s*", re.I)
_CITES = re.compile(r"(?:\s*\[\d+\])+\s*$")
_ANY_CITE = re.compile(r"\[\d+\]")
# Fillers that stand for no content.
_NOTHING = {"", "na", "null", "none", "nan", "nil", "없음", "undefined", "tbd", "empty", "답변", "답", "answer", "response"}
# Ways to decline an answer. Statements that the documents don't hold the fact are none.
_REFUSAL = re.compile(
    r"답변\s*(?:을\s*)?드릴 수 없|답변\s*드리기 (?:곤란|어렵)|답변을 거[절부]|말씀\s*드리기 (?:곤란|어렵)|말씀\s*드릴 수 없|도와\s*드릴 수 없|도와\s*드리기 (?:곤란|어렵)"
    r"|(?:조언|정보|답변|도움|의견|안내)(?:은|는|을|를)? 드리기 (?:곤란|어렵)|제공하지 않겠|제공해 드릴 수 없|제공할 수 없는 (?:정보|내용|주제)|응답하지 않도록|응답할 수 없|대답할 수 없|대답하지 않"
    r"|AI (?:언어 )?모델(?:이므로|로서|이라|이기|이어서|입니다)|인공지능(?: 모델)?(?:이므로|으로서|이라|이기)|판단을 내릴 수 없|판단할 수 없는 (?:주제|내용)"
    r"|수행할 수 있는 범위를 벗어|제 (?:역할|능력|권한) 밖|요청(?:에는|은|을) (?:따를|수행할|처리할|들어\s*드릴) 수 없|정책(?:상|에 따라) [^.]{0,30}(?:없|않)"
    r"|i(?:'|’)?m sorry,? but i|i am sorry,? but i|i (?:can(?:'|’)?t|cannot|can not|won(?:'|’)?t|will not|am not able to|am unable to|must decline|have to decline|decline to)\b|i(?:'|’)?m (?:unable|not able) to"
    r"|as an ai (?:language )?model|申し訳|お答えできません|回答できません|お手伝いできません|抱歉|无法(?:回答|提供|协助)|不能(?:回答|提供)|lo siento|no puedo (?:ayudar|responder)|es tut mir leid|ich kann (?:das|diese|dabei|ihnen)[^.]{0,40}nicht|désolé|je ne peux pas|xin lỗi|tôi không thể|к сожалению|не могу (?:ответить|помочь)",
    re.I,
)
# Frequent function words of languages in Latin letters.
_FUNCTION = {
    "en": "the of and to in is are be a an for with by on at that this must shall not from before after has have each every without than",
    "es": "el la los las de y que en un una por para con del se debe antes cada al es no",
    "de": "der die das und ist ein eine vor für mit dem den alle muss nicht zu von im auf des",
    "fr": "le la les de et des un une pour avec dans est doit avant chaque du au ne pas que",
    "vi": "phải trong và ngày trước khi nhà các của là được cho bản một có không",
    "pt": "o os as de e do da em um uma para com deve antes cada não que no na",
    "it": "il lo gli di e del della in un una per con deve prima ogni non che al",
    "id": "yang dan di untuk dengan harus sebelum setiap dari pada ini tidak",
}
_FUNCTION_SETS = {k: frozenset(v.split()) for k, v in _FUNCTION.items()}
_END = re.compile(r"[.!?。？！…][\"'”’)\]」』>]*$")


def body(answer: str) -> str:
    """The answer in one form, without its list of sources, citations at its end and label."""
    s = _SOURCES.sub("", unify(answer)).strip()
    s = _CITES.sub("", s).strip()
    return _LABEL.sub("", s).strip()


def letters(s: str) -> str:
    """Letters and digits, lower case."""
    return "".join(filter(str.isalnum, s)).lower()


def language(s: str) -> str:
    """The language of a text by its script and, within Latin letters, by function words; '' if unclear."""
    n = {"hangul": 0, "kana": 0, "han": 0, "cyrillic": 0, "latin": 0, "other": 0}
    for c in s:
        if "가" <= c <= "힣" or "ㄱ" <= c <= "ㆎ":
            n["hangul"] += 1
        elif "ぁ" <= c <= "ヿ":
            n["kana"] += 1
        elif "一" <= c <= "鿿":
            n["han"] += 1
        elif "Ѐ" <= c <= "ӿ":
            n["cyrillic"] += 1
        elif c.isalpha():
            n["latin" if "LATIN" in unicodedata.name(c, "") else "other"] += 1
    words = re.findall(r"[^\W\d_]+", s.lower())
    lower = re.findall(r"\b[a-zà-ỹ]{2,}\b", s)
    total = sum(n.values())
    if not total:
        return ""
    if n["kana"] >= 0.1 * total and n["hangul"] < n["kana"]:
        return "ja"
    best = max(_FUNCTION_SETS, key=lambda k: sum(w in _FUNCTION_SETS[k] for w in words))
    hits = sum(w in _FUNCTION_SETS[best] for w in words)
    main = max(n, key=n.get)
    if main == "latin":
        # technical words in Latin letters may stand in a Korean sentence, Korean names in an English one
        if n["hangul"] >= 0.2 * total and hits < 2:
            return "ko"
        return (best if hits else "latin") if len(lower) >= 3 else ""
    return {"hangul": "ko", "han": "zh", "cyrillic": "ru", "kana": "ja"}.get(main, "other")


def ends_within(raw: str, text: str, suspect: bool) -> bool:
    """Whether an answer breaks off: no end mark, citation or source list closes it. A closing Korean
    ending without end mark passes, unless the answer is suspect by its length or its neighbour."""
    if _END.search(text) or _CITES.search(unify(raw).rstrip()) or _SOURCES.search(unify(raw)):
        return False
    # one that closes its other sentences with a mark would close the last one too
    return suspect or "\n" in text or re.search(r"[.!?]\s", text) is not None or re.search(r"[가-힣](?:다|요|까|죠)$", text) is None


def classify(question: str | None, answer: str | None, shortened: bool, spike: bool) -> str | None:
    """The defect of one pair, or None."""
    raw = answer or ""
    text = body(raw)
    a = letters(_ANY_CITE.sub("", text))
    if a in _NOTHING:
        return "empty"
    q = letters(body(question or ""))
    if len(q) >= 8 and (a == q or (q in a and len(a.replace(q, "")) <= 8)):
        return "copy"
    if len(a) >= 12 and a in q and len(a) >= 0.8 * len(q):
        return "copy"
    # the question in slightly other words at its end
    if len(q) >= 12 and len(a) <= len(q) + 8 and len(commonprefix([a, q])) >= 0.85 * len(q):
        return "copy"
    if _REFUSAL.search(text):
        return "refusal"
    lq, la = language(question or ""), language(text)
    if lq and la and lq != la and len(a) >= 8:
        return "other_language"
    short = len(text) <= 20 and "\n" not in text and not (shortened and " " in text)
    if not short and ends_within(raw, text, spike or shortened):
        return "truncated"
    return None


def prefix_flags(results: DataFrame) -> DataFrame:
    """(answer_text, shortened) of the distinct answers: whether the next answer in text order continues it."""

    def run(it):
        last = None
        first = True
        for batch in it:
            out = []
            for s in batch.column(0).to_pylist():
                if last is not None:
                    out.append((last, s.startswith(last), first, False))
                    first = False
                last = s
            if out:
                yield _rows(out)
        if last is not None:
            yield _rows([(last, False, first, True)])

    def _rows(out):
        a, b, c, d = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d)], names=["answer_text", "shortened", "at_start", "at_end"])

    from ..session import materialize

    texts = results.where("answer_text <> ''").select("answer_text").distinct()
    flags = materialize(texts.repartitionByRange("answer_text").sortWithinPartitions("answer_text").mapInArrow(run, "answer_text string, shortened boolean, at_start boolean, at_end boolean"), "prefixes")
    # the last text of a range meets the first one of the next: two rows per range
    edge = flags.where("at_start or at_end").withColumn("next", F.lead("answer_text").over(W.orderBy("answer_text"))).where("at_end").select("answer_text", F.startswith("next", "answer_text").alias("shortened"))
    return flags.where("not at_end").select("answer_text", "shortened").union(edge.select("answer_text", F.coalesce("shortened", F.lit(False))))


def spikes(results: DataFrame, reach: int = 12, times: float = 6.0, least: int = 12, shortest: int = 40) -> DataFrame:
    """(n_chars): lengths at which far more distinct answers end than at the lengths around."""
    h = results.select("answer_text").distinct().groupBy(F.length("answer_text").alias("n_chars")).agg(F.count("*").alias("n"))
    around = W.orderBy("n_chars").rangeBetween(-reach, reach)  # one row per length
    return h.where(F.col("n_chars") >= shortest).withColumn("all", F.sum("n").over(around)).where((F.col("n") >= least) & (F.col("n") > times * (F.col("all") - F.col("n")) / (2 * reach))).select("n_chars")


def defects(results: DataFrame) -> DataFrame:
    """(result_id, defect) of each defective row; a row that repeats is returned once.

    A null answer is empty; a null question is in no language and can't be copied. is_empty is not
    relied upon, since it is null or wrong at times.
    """
    base = results.where("result_id is not null").select("result_id", "question", F.coalesce("final_answer", F.lit("")).alias("answer_text")).dropDuplicates(["result_id"])
    # only answers that another one continues: a popular answer meets few rows, whatever the share of all rows it has
    known = base.join(prefix_flags(base).where("shortened"), "answer_text", "left").join(spikes(base).select("n_chars", F.lit(True).alias("spike")), F.length("answer_text") == F.col("n_chars"), "left")

    def run(it):
        for batch in it:
            q, a, s, k = (batch.column(i).to_pylist() for i in range(1, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([classify(*x) for x in zip(q, a, s, k)], pa.string())], names=["result_id", "defect"])

    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return known.select(F.col("result_id").cast("long"), "question", "answer_text", flag("shortened"), flag("spike")).mapInArrow(run, "result_id long, defect string").where("defect is not null")


def found(results: DataFrame) -> DataFrame:
    return defects(results)
