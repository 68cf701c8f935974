"""The registered queries over the test tables, and the SQL that each is held against.

Every query runs over its whole tables. A query without SQL is tested against brute force in tests/.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as ft
from ..functions import text as fx
from ..operators import chunking, evaluation, images, index, metadata, profile, reports, retrieval
from ..session import materialize, stands, table as t
from ..sources.parsers import embed_column, term_embedder

QUERIES: dict = {}
SQL: dict[str, str] = {}
_WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SQUEEZE = f"trim(regexp_replace(%s, '{_WS}', ' ', 'g'))"
_TOKENS = "list_transform(regexp_extract_all(%s, '[0-9A-Za-z가-힣]+'), lambda x: lower(x))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def chunks_once(s, d):
    """Chunks without their redeliveries: of the rows of one id, the earliest."""
    return earliest(t(s, d, "sample_chunks"))


def earliest(c):
    return c.groupBy("chunk_id").agg(F.min_by(F.struct("doc_id", "text", "metadata"), F.struct(F.col("loaded_at").isNull(), "loaded_at")).alias("c")).select("chunk_id", "c.*")


def once(c):
    """The same, where all rows are needed whole: ids are counted first, and only rows whose id comes again are
    exchanged."""
    again = retrieval.named(c.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1"), "chunk_id")("chunk_id")
    return c.where(~again).select("chunk_id", "doc_id", "text", "metadata").union(earliest(c.where(again)))


_BUILT: dict[tuple, object] = {}


def built(s, d, name: str, make):
    """A table or an index that several queries read: made once per application and folder, and anew if its
    table has been removed."""
    at = (s.sparkContext.applicationId, d, name)
    if at not in _BUILT or not stands(getattr(_BUILT[at], "texts", _BUILT[at])):
        _BUILT[at] = make()
    return _BUILT[at]


def collection(s, d):
    """The chunks without redeliveries, as a written table."""
    return built(s, d, "chunks", lambda: materialize(once(t(s, d, "sample_chunks")), "chunks"))


def chunk_index(s, d):
    return built(s, d, "index", lambda: retrieval.lexical_index(collection(s, d), "chunk_id", "text", "metadata"))


def chunk_vectors(s, d):
    """(key, vector) of the chunks, by the stand-in for a model that SQL can follow."""
    make = lambda: embed_column(collection(s, d).select(F.col("chunk_id").alias("key"), "text"), embedder=term_embedder()).select("key", "vector")
    return built(s, d, "vectors", lambda: materialize(make(), "vectors"))


_CHUNKS = "(select chunk_id, first(doc_id) as doc_id, first(text) as text, first(metadata) as metadata from sample_chunks group by chunk_id)"

# ---- text ------------------------------------------------------------------------------------


@query("token_counts", f"""
select term, count(*) as n, count(distinct doc_id) as n_docs
from (select doc_id, unnest({_TOKENS % 'text'}) as term from documents) group by term""")
def _(s, d):
    p = retrieval.postings(t(s, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))


@query("chunk_fixed", f"""
with s as (select doc_id, {_SQUEEZE % 'text'} as s from documents where text is not null),
n as (select doc_id, s, case when length(s) = 0 then 0 when length(s) <= 800 then 1 else cast(ceil((length(s) - 800) / 680.0) as int) + 1 end as n from s),
p as (select doc_id, s, unnest(generate_series(1, n)) as part_no from n)
select doc_id, doc_id::varchar || '_chunk_' || lpad(part_no::varchar, 4, '0') as chunk_id, part_no, substring(s, (part_no - 1) * 680 + 1, 800) as text from p""")
def _(s, d):
    return chunking.body_chunks(t(s, d, "documents"))


_BUL = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x{AD}\x{FFFD}"
_SPC = r"\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{200B}\x{FEFF}"
_REM = rf"[^\PC\n\t{_BUL}{_SPC}]"
_BLANK = rf"(?:[{_SPC}\x20\x{{1680}}\x{{2028}}\x{{2029}}]|{_REM})*"


@query("normalized_characters", rf"""
select chunk_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^({_BLANK})[{_BUL}]', '\1- ', 'g'), '[{_BUL}]', ' ', 'g'), '[{_SPC}]', ' ', 'g'), '{_REM}', '', 'g') as text,
  len(regexp_extract_all(text, '[{_BUL}]')) as n_bullets, len(regexp_extract_all(text, '{_REM}')) as n_removed, len(regexp_extract_all(text, '[{_SPC}]')) as n_spaces
from {_CHUNKS} where text is not null""")
def _(s, d):
    c = chunks_once(s, d).where("text is not null")
    return c.select("chunk_id", fx.normalize_characters("text").alias("x")).select("chunk_id", "x.*")


_REPEATED = f"i > 1 and l[i] = l[i - 1] and length({_SQUEEZE % 'l[i]'}) >= 8"


@query("repeated_lines", f"""
with s as (select chunk_id, string_split(text, chr(10)) as l from {_CHUNKS} where text is not null),
i as (select chunk_id, l, unnest(generate_series(1, len(l))) as i from s),
f as (select chunk_id, i, l[i] as line, coalesce({_REPEATED}, false) as gone from i)
select chunk_id, string_agg(line, chr(10) order by i) filter (not gone) as text, count(*) filter (gone) as n_lines,
  coalesce(sum(length(regexp_replace(line, '[^0-9]', '', 'g'))) filter (gone), 0)::bigint as n_digits from f group by chunk_id""")
def _(s, d):
    c = chunks_once(s, d).where("text is not null")
    return c.select("chunk_id", fx.drop_repeated_lines("text").alias("x")).select("chunk_id", "x.*")


_STRIP = r"regexp_replace(%s, '^[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"


@query("blank_lines", f"""
with s as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: {_STRIP % "regexp_replace(x, '[ \t]{2,}', ' ', 'g')"}) as l from documents where text is not null),
i as (select doc_id, l, unnest(generate_series(1, len(l))) as i from s),
f as (select doc_id, i, l[i] as line, l[i] = '' and i > 1 and l[i - 1] = '' as gone from i)
select doc_id, {_STRIP % "string_agg(line, chr(10) order by i) filter (not gone)"} as text, count(*) filter (gone) as n_blank from f group by doc_id""")
def _(s, d):
    return t(s, d, "documents").where("text is not null").select("doc_id", fx.collapse_blank("text").alias("x")).select("doc_id", "x.*")


@query("preservation_keys", """
select chunk_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z]{2,4}-[0-9]{3,4}'))), ';') as ids, length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digits
from """ + _CHUNKS + " where text is not null")
def _(s, d):
    return chunks_once(s, d).where("text is not null").select("chunk_id", F.array_join(fx.requirement_ids("text"), ";").alias("ids"), fx.digit_count("text").alias("n_digits"))


@query("clean_totals", f"""
with s as (select regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^({_BLANK})[{_BUL}]', '\\1- ', 'g'), '[{_BUL}]', ' ', 'g'), '[{_SPC}]', ' ', 'g'), '{_REM}', '', 'g') as a,
  len(regexp_extract_all(text, '[{_BUL}]')) as n_bullets, len(regexp_extract_all(text, '{_REM}')) as n_removed, len(regexp_extract_all(text, '[{_SPC}]')) as n_spaces, chunk_id from {_CHUNKS} where text is not null),
l as (select chunk_id, string_split(a, chr(10)) as l from s), i as (select chunk_id, l, unnest(generate_series(1, len(l))) as i from l),
r as (select chunk_id, count(*) filter ({_REPEATED}) as n_lines from i group by chunk_id)
select count(*) as n_chunks, sum(n_bullets)::bigint as n_bullets, sum(n_removed)::bigint as n_removed, sum(n_spaces)::bigint as n_spaces, sum(n_lines)::bigint as n_lines from s join r using (chunk_id)""")
def _(s, d):
    c = fx.clean(collection(s, d).where("text is not null"))
    return c.agg(F.count("*").alias("n_chunks"), *[F.sum(f"clean.{n}").cast("long").alias(n) for n in ("n_bullets", "n_removed", "n_spaces", "n_lines")])


@query("clean_report")
def _(s, d):
    meta = t(s, d, "source_metadata").select("doc_id", F.array_distinct(F.concat(F.filter(F.array("project_name", "notice_number"), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.coalesce(fx.amount_forms("budget"), F.array().cast("array<string>")))).alias("known_values"))
    c = fx.clean(chunks_once(s, d).where("text is not null").join(meta, "doc_id", "left"))
    x = c.select("chunk_id", "clean", fx.preservation("text", "clean.text", "known_values", "clean.n_digits").alias("kept"))
    return x.select("chunk_id", F.sha2("clean.text", 256).alias("text_sha256"), "clean.n_bullets", "clean.n_removed", "clean.n_spaces", "clean.n_lines", "clean.n_blank", F.array_join("kept.lost_ids", ";").alias("lost_ids"), F.array_join("kept.lost_values", ";").alias("lost_values"), "kept.checked_values", "kept.digit_loss", "kept.preserved")


@query("document_hashes", "select doc_id, sha256(text) as text_sha256 from documents where text is not null")
def _(s, d):
    return t(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("calculations")
def _(s, d):
    q = t(s, d, "questions").where("calculation is not null")
    return q.select("question_id", "calculation", ft.calculate("calculation").alias("x")).select("question_id", "calculation", F.round("x.value", 6).alias("value"), "x.error")


# ---- chunks ----------------------------------------------------------------------------------


def tables_once(s, d):
    """Table records without those repeated as they are."""
    r = t(s, d, "table_records")
    return r.dropDuplicates(["record_id"])


@query("table_chunks")
def _(s, d):
    return chunking.table_chunks(tables_once(s, d))


@query("table_chunks_headline")
def _(s, d):
    r = tables_once(s, d).join(metadata.standard(t(s, d, "source_metadata")).select("doc_id", "agency", "title"), "doc_id", "left")
    r = r.withColumn("table_markdown", F.col("table_markdown"))
    head = r.select("doc_id", chunking.headline("agency", "title").alias("head")).distinct()
    return chunking.table_chunks(r).join(head, "doc_id").withColumn("text", F.concat("head", "text")).drop("head")


@query("image_chunks")
def _(s, d):
    return chunking.image_chunks(t(s, d, "image_records"))


@query("section_chunks", f"""
with c as (select chunk_id as source_id, nullif(regexp_extract(text, '^\\[([^\\]\\n]{{1,40}})\\]\\n', 1), '') as title, {_SQUEEZE % "regexp_replace(text, '^\\[[^\\]\\n]{1,40}\\]\\n', '')"} as s from {_CHUNKS} where text is not null),
n as (select *, case when length(s) = 0 then 0 when length(s) <= 800 then 1 else cast(ceil((length(s) - 800) / 680.0) as int) + 1 end as n from c),
p as (select *, unnest(generate_series(1, n)) as i from n)
select source_id, source_id || '_chunk_' || lpad(i::varchar, 4, '0') as chunk_id, title as section_title, coalesce('[' || title || ']' || chr(10), '') || substring(s, (i - 1) * 680 + 1, 800) as text from p""")
def _(s, d):
    # a chunk that opens with a bracketed title is a section of its document
    c = chunks_once(s, d).where("text is not null")
    one = c.select("chunk_id", "text", F.array(F.struct(F.regexp_extract("text", r"^\[([^\]\n]{1,40})\]\n", 1).alias("title"), F.regexp_replace("text", r"^\[[^\]\n]{1,40}\]\n", "").alias("text"))).alias("sections"))
    return chunking.section_chunks(one.withColumnRenamed("chunk_id", "source_id"), "source_id")


@query("contract_violations", f"""
select chunk_id, reason from (select chunk_id, coalesce(case when chunk_id is null then 'missing chunk_id' end, case when doc_id is null then 'missing doc_id' end, case when text is null then 'missing text' end,
  case when metadata is null then 'missing metadata' end,
  {', '.join(f"case when coalesce(trim(element_at(metadata, '{k}')[1]) = '', true) then 'missing metadata.{k}' end" for k in chunking.REQUIRED_METADATA)},
  case when trim(text, ' ') = '' then 'blank text' end) as reason from {_CHUNKS}) where reason is not null""".replace("element_at(metadata, 'title')[1]", "metadata['title']").replace("element_at(metadata, 'project_name')[1]", "metadata['project_name']").replace("element_at(metadata, 'agency')[1]", "metadata['agency']").replace("element_at(metadata, 'file_name')[1]", "metadata['file_name']"))
def _(s, d):
    return chunking.contract_violations(chunks_once(s, d))


@query("image_context", """
with c as (select record_id, combined_context as stored, concat_ws(chr(10) || chr(10), '이미지 OCR 텍스트:' || chr(10) || coalesce(ocr_text, ''),
  case when len(spatial_layout.layout_rows) > 0 then '공간 배치(화살표 흐름 아님):' || chr(10) || array_to_string(list_transform(spatial_layout.layout_rows, lambda x: '행 ' || x.row_index || ': ' || array_to_string(list_transform(x.items, lambda y: y.text), ' | ')), chr(10)) end,
  case when coalesce(vlm_text, '') <> '' then '검토 필요 VLM 개요:' || chr(10) || vlm_text end) as built from image_records where combined_context is not null)
select record_id, sha256(built) as context_sha256, built = stored as as_stored from c""")
def _(s, d):
    im = t(s, d, "image_records")
    built = ft.combined_context("ocr_text", "spatial_layout.layout_rows", "vlm_text")
    return im.where("combined_context is not null").select("record_id", F.sha2(built, 256).alias("context_sha256"), (built == F.col("combined_context")).alias("as_stored"))


@query("image_types", r"""
select record_id, lower(coalesce(nullif(regexp_extract(coalesce(vlm_text, ''), '(?im)^(?:유형|type)\s*[:：]\s*(diagram|form|table|chart|logo|photo|other)\b', 1), ''),
  nullif(regexp_extract(coalesce(vlm_text, ''), '(?i)\b(diagram|form|table|chart|logo|photo|other)\b', 1), ''), 'other')) as parsed_type from image_records""")
def _(s, d):
    return t(s, d, "image_records").select("record_id", ft.image_type("vlm_text").alias("parsed_type"))


@query("image_gates", """
with g as (select record_id, width, height, image_type, case when coalesce(width < 200 or height < 100, true) then 'image_too_small' when length(coalesce(ocr_text, '')) < 2 then 'ocr_text_too_short' end as reason, coalesce(width < 500 or height < 200, true) as small from image_records)
select record_id, case when reason is null then 'applied' else 'excluded' end as status, reason, case when small then 'unclassified' else coalesce(image_type, 'other') end as model_type,
  case when small then 'skipped' else 'applied' end as model_status, not small and coalesce(image_type, 'other') not in ('logo', 'photo') as keeps_text from g""")
def _(s, d):
    g = t(s, d, "image_records").select("record_id", images.ocr_gate("width", "height", "ocr_text").alias("a"), images.model_gate("width", "height", F.col("image_type")).alias("b"))
    return g.select("record_id", "a.status", "a.reason", F.col("b.image_type").alias("model_type"), F.col("b.status").alias("model_status"), "b.keeps_text")


@query("image_first_seen", """
select record_id, case when row_number() over (partition by doc_id, image_sha256 order by image_number, record_id) = 1 then 'ok' else 'duplicate' end as status from image_records""")
def _(s, d):
    return metadata.first_seen(t(s, d, "image_records"), ["doc_id", "image_sha256"], ["image_number", "record_id"]).select("record_id", "status")


@query("layout_rows", """
with r as (select record_id, unnest(spatial_layout.layout_rows) as r from image_records), i as (select record_id, unnest(r.items) as i from r),
b as (select record_id, i.text as text, (i.bbox.x_left + i.bbox.x_right) / 2.0 as x, (i.bbox.y_top + i.bbox.y_bottom) / 2.0 as y, i.bbox.y_bottom - i.bbox.y_top as h from i),
l as (select record_id, median(h) * 1.5 as lim from b group by record_id),
j as (select b.*, coalesce(y - lag(y) over (partition by record_id order by y, x, text) > lim, false)::int as jump from b join l using (record_id)),
n as (select *, sum(jump) over (partition by record_id order by y, x, text rows unbounded preceding) + 1 as row_no from j)
select record_id, row_no::bigint as row_no, string_agg(text, ' | ' order by x, text) as text from n group by record_id, row_no""")
def _(s, d):
    return images.layout_rows(images.layout_items(t(s, d, "image_records")))


@query("largest_image", "select doc_id, arg_max(record_id, (coalesce(width * height, 0)::bigint * 10000000 - record_id)) as record_id, max(coalesce(width * height, 0))::bigint as area from image_records group by doc_id")
def _(s, d):
    return images.largest_image(t(s, d, "image_records"))


@query("table_markdown", r"""
with n as (select n_regionkey, n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey)
select r_name as region, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) order by n_nationkey) as markdown from n group by r_name""")
def _(s, d):
    n = t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy(F.col("r_name").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells")))).alias("x"))  # a region's nations
    return rows.select("region", ft.rows_markdown(F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), F.transform("x", lambda v: v["cells"]))).alias("markdown"))


@query("table_roundtrip")
def _(s, d):
    m = ft.markdown_rows("table_markdown")
    return tables_once(s, d).where("table_markdown is not null").select("record_id", ft.rows_markdown(m).alias("markdown"), F.round(ft.cell_density(m), 3).alias("density"))


@query("content_tables", """
select distinct on (record_id) record_id, case when coalesce(n_rows < 2 or n_columns < 2, true) then 'layout_table' when coalesce(density < 0.2, true) then 'low_density' end as drop_reason,
  coalesce(n_rows >= 2 and n_columns >= 2 and density >= 0.2, false) as is_content from table_records""")
def _(s, d):
    return tables_once(s, d).select("record_id", ft.table_drop_reason("n_rows", "n_columns", "density").alias("drop_reason"), ft.is_content_table("n_rows", "n_columns", "density").alias("is_content"))


@query("table_totals", """
with r as (select distinct on (record_id) * from table_records)
select extraction_method, count(*) as n, count(*) filter (status = 'extracted') as n_extracted, count(*) filter (status = 'failed') as n_failed, count(*) filter (status = 'duplicate') as n_duplicate,
 count(*) filter (coalesce(trim(table_markdown), '') <> '' and n_rows > 1 and n_columns > 1) as n_usable from r group by extraction_method""")
def _(s, d):
    c = F.col("status")
    usable = (F.coalesce(F.trim("table_markdown"), F.lit("")) != "") & (F.col("n_rows") > 1) & (F.col("n_columns") > 1)
    return tables_once(s, d).groupBy("extraction_method").agg(F.count("*").alias("n"), F.count_if(c == "extracted").alias("n_extracted"), F.count_if(c == "failed").alias("n_failed"), F.count_if(c == "duplicate").alias("n_duplicate"), F.count_if(usable).alias("n_usable"))


# ---- retrieval -------------------------------------------------------------------------------


def asked(s, d):
    """The stated query set: questions whose number is divisible by 20."""
    return t(s, d, "questions").where(F.substring("question_id", 2, 12).cast("long") % 20 == 0).select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "filters")


_ASKED = "(select question_id as query_id, question as query, filters from questions where substring(question_id, 2)::bigint % 20 = 0)"
_INDEX = f"""
asked as {_ASKED}, once as {_CHUNKS},
tok as (select chunk_id, unnest({_TOKENS % 'text'}) as term from once), post as (select chunk_id, term, count(*) as tf from tok group by all),
qtok as (select query_id, unnest({_TOKENS % 'query'}) as term from asked), qpost as (select query_id, term, count(*) as qtf from qtok group by all)"""
_BM25 = f"""{_INDEX},
lens as (select chunk_id, coalesce(len({_TOKENS % 'text'}), 0) as n_terms from once), corpus as (select count(*) as n, avg(n_terms) as mean from lens),
dfs as (select term, count(*) as df from post group by term), raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as r from dfs, corpus), fl as (select avg(r) * 0.25 as f from raw),
idf as (select term, case when r < 0 then f else r end as idf from raw, fl),
bm25 as (select query_id, chunk_id as key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / mean))), 6) as score, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_terms / mean))) as raw
  from post join qpost using (term) join idf using (term) join lens using (chunk_id), corpus group by all having raw > 0)"""
_COS = """
dn as (select chunk_id, sqrt(sum(tf * tf)) as a from post group by chunk_id), qn as (select query_id, sqrt(sum(qtf * qtf)) as b from qpost group by query_id),
dots as (select query_id, chunk_id, sum(tf * qtf) as dot from post join qpost using (term) group by all),
cosine as (select query_id, chunk_id as key, round(dot / (a * b), 4) as score from dots join dn using (chunk_id) join qn using (query_id))"""
_RANK = "select query_id, key, score, rank from (select query_id, key, score, row_number() over (partition by query_id order by score desc, key) as rank from %s) where rank <= %d"
_MATCH = "len(list_filter(map_entries(coalesce(filters, map([]::varchar[], []::varchar[]))), lambda e: not contains(lower(coalesce(metadata[e.key], '')), lower(coalesce(e.value, 'none'))))) = 0"


@query("bm25_topk", f"with {_BM25} {_RANK % ('bm25', 5)}")
def _(s, d):
    return retrieval.lexical_top(asked(s, d), chunk_index(s, d), 5).select("query_id", "key", "score", "rank")


_PLAIN = "kept as (select b.query_id, b.key, b.score from %s b join asked a using (query_id) join once c on c.chunk_id = b.key where " + _MATCH + ")"


@query("bm25_filtered", f"with {_BM25}, {_PLAIN % 'bm25'} {_RANK % ('kept', 5)}")
def _(s, d):
    return retrieval.search("openai", "bm25", asked(s, d), collection(s, d), "chunk_id", chunk_index(s, d)).select("query_id", "key", "score", "rank")


@query("lexical_topk", f"with {_INDEX}, {_COS}, {_PLAIN % 'cosine'} {_RANK % ('kept', 3)}")
def _(s, d):
    return retrieval.search("baseline", "lexical", asked(s, d), collection(s, d), "chunk_id", chunk_index(s, d)).select("query_id", "key", "score", "rank")


_NORM = "(select query_id, key, case when hi = lo then case when hi > 0 then 1.0 else 0.0 end else (score - lo) / (hi - lo) end as norm from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from %s))"
_H = "('0x' || substr(md5(term), 1, 8))::bigint"
_VECTORS = f"""
cv as (select chunk_id, {_H} % 64 as d, sum(tf * case when {_H} >= 2147483648 then 1 else -1 end)::double as x from post group by all),
qv as (select query_id, {_H} % 64 as d, sum(qtf * case when {_H} >= 2147483648 then 1 else -1 end)::double as x from qpost group by all),
cl as (select chunk_id, sqrt(sum(x * x)) as a from cv group by chunk_id), ql as (select query_id, sqrt(sum(x * x)) as b from qv group by query_id),
vdots as (select query_id, chunk_id, sum(cv.x * qv.x) as dot from cv join qv using (d) group by all),
dense as (select a.query_id, c.chunk_id as key, coalesce(round(dot / nullif(cl.a * ql.b, 0), 6), 0) as score
  from asked a cross join once c left join vdots v on v.query_id = a.query_id and v.chunk_id = c.chunk_id left join cl on cl.chunk_id = c.chunk_id left join ql on ql.query_id = a.query_id)"""
_FOLDED = _SQUEEZE % "lower(nfc_normalize(%s))"
_MATCH_FOLDED = f"len(list_filter(map_entries(coalesce(filters, map([]::varchar[], []::varchar[]))), lambda e: {_FOLDED % "coalesce(e.value, '')"} <> '' and not contains({_FOLDED % "coalesce(metadata[e.key], '')"}, {_FOLDED % "coalesce(e.value, '')"}))) = 0"


def _dense_filtered(most: int) -> str:
    """SQL of the dense search with the normalised filter: `most` rows, out of 100 for queries with filters."""
    return f"""pool as (select query_id, key, score, row_number() over (partition by query_id order by score desc, key) as r from dense),
near as (select p.query_id, p.key, p.score from pool p join asked a using (query_id) join once c on c.chunk_id = p.key
  where r <= case when coalesce(cardinality(filters), 0) > 0 then 100 else {most} end and {_MATCH_FOLDED})"""


def _fused(dense: str, sparse: str) -> str:
    return f"""d50 as ({_RANK % (dense, 50)}), b50 as ({_RANK % (sparse, 50)}), dn as {_NORM % 'd50'}, bn as {_NORM % 'b50'},
fused as (select coalesce(dn.query_id, bn.query_id) as query_id, coalesce(dn.key, bn.key) as key, round(0.8 * coalesce(dn.norm, 0) + (1 - 0.8) * coalesce(bn.norm, 0), 4) as score from dn full join bn on dn.query_id = bn.query_id and dn.key = bn.key)"""


def asked_vectors(s, d):
    return embed_column(asked(s, d), "query", term_embedder())


def unfiltered(q):
    return q.withColumn("filters", F.lit(None).cast("map<string,string>"))


def found(s, d, name: str, q, **more):
    return retrieval.search("openai", name, q, collection(s, d), "chunk_id", chunk_index(s, d), chunk_vectors(s, d), **more).select("query_id", "key", "score", "rank")


@query("hybrid_topk", f"with {_BM25}, {_VECTORS}, {_fused('dense', 'bm25')} {_RANK % ('fused', 5)}")
def _(s, d):
    return found(s, d, "hybrid", unfiltered(asked_vectors(s, d)))


@query("hybrid_filtered", f"with {_BM25}, {_VECTORS}, {_dense_filtered(50)}, {_PLAIN % 'bm25'}, {_fused('near', 'kept')} {_RANK % ('fused', 5)}")
def _(s, d):
    return found(s, d, "hybrid", asked_vectors(s, d))


@query("dense_normalised_filter", f"with {_INDEX}, {_VECTORS}, {_dense_filtered(5)} {_RANK % ('near', 5)}")
def _(s, d):
    return found(s, d, "similarity", asked_vectors(s, d))


@query("mmr_filtered")
def _(s, d):
    return found(s, d, "mmr", asked_vectors(s, d))


@query("rerank_topk", f"""with {_BM25}, {_VECTORS}, {_fused('dense', 'bm25')}, cand as ({_RANK % ('fused', 50)}),
qt as (select query_id, list_distinct({_TOKENS % 'query'}) as q from asked), ct as (select chunk_id, {_TOKENS % 'text'} as w from once),
again as (select c.query_id, c.key, round(len(list_intersect(q, w)) / len(q)::double, 6) as score from cand c join qt using (query_id) join ct on ct.chunk_id = c.key) {_RANK % ('again', 5)}""")
def _(s, d):
    return found(s, d, "hybrid", unfiltered(asked_vectors(s, d)), use_rerank=True)


@query("context_blocks", f"""with {_BM25}, top as ({_RANK % ('bm25', 5)})
select query_id, string_agg('[' || rank || '] title=' || coalesce(metadata['title'], '제목 없음') || ' agency=' || coalesce(metadata['agency'], '기관 없음') || ' source=' || coalesce(metadata['file_name'], '출처 없음') || ' score=' || score || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as context
from top join once on once.chunk_id = top.key group by query_id""")
def _(s, d):
    top = retrieval.lexical_top(asked(s, d), chunk_index(s, d), 5)
    return retrieval.context_blocks(top, collection(s, d), "chunk_id")


def vector_sides(s, d):
    v = t(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    return v.where("key % 20 = 0").select(F.col("key").alias("query_id"), "vector", F.col("label").alias("query_label")), v


_DENSE = """q as (select vec_id as query_id, embedding::double[] as qv, label as query_label from embeddings where vec_id % 20 = 0),
dense as (select query_id, query_label, vec_id as key, label, round(list_cosine_similarity(qv, embedding::double[]), 6) as score from q, embeddings)"""


@query("dense_topk", f"with {_DENSE} {_RANK % ('dense', 5)}")
def _(s, d):
    q, v = vector_sides(s, d)
    return retrieval.dense_scores(q, v, 5).select("query_id", "key", "score", "rank")


@query("dense_filtered", f"""with {_DENSE}, pool as (select *, row_number() over (partition by query_id order by score desc, key) as r from dense), kept as (select * from pool where r <= 100 and label = query_label) {_RANK % ('kept', 5)}""")
def _(s, d):
    q, v = vector_sides(s, d)
    pool = retrieval.dense_scores(q, v, retrieval.FETCH_K).select("query_id", "key", "score")
    kept = pool.join(q.select("query_id", "query_label"), "query_id").join(v.select("key", "label"), "key").where("label = query_label")
    return retrieval.top_k(kept.select("query_id", "key", "score"), 5)


def _mmr_sql(k: int) -> str:
    """SQL of k greedy choices, one after the other."""
    parts = [f"""{_DENSE}, pool as (select query_id, key, row_number() over (partition by query_id order by score desc, key) as r from dense),
p as (select pool.query_id, pool.key, r, v.embedding::double[] as v, list_cosine_similarity(v.embedding::double[], q.embedding::double[]) as near from pool join embeddings v on v.vec_id = pool.key join embeddings q on q.vec_id = pool.query_id where r <= 100),
c1 as (select query_id, key, v, 1 as rank from p where r = 1)"""]
    for i in range(2, k + 1):
        parts.append(f"""m{i} as (select p.query_id, p.key, any_value(p.v) as v, any_value(p.r) as r, round(0.7 * any_value(near) - (1 - 0.7) * max(list_cosine_similarity(p.v, c.v)), 12) as g from p join c{i - 1} c on c.query_id = p.query_id
  where not exists (select 1 from c{i - 1} x where x.query_id = p.query_id and x.key = p.key) group by p.query_id, p.key),
c{i} as (select * from c{i - 1} union all select query_id, key, v, {i} from (select *, row_number() over (partition by query_id order by g desc, r) as o from m{i}) where o = 1)""")
    return f"with {', '.join(parts)} select query_id, key, rank::int as rank, 0.0::double as score from c{k}"


@query("mmr_topk", _mmr_sql(5))
def _(s, d):
    q, v = vector_sides(s, d)
    return retrieval.mmr(retrieval.dense_scores(q, v, retrieval.FETCH_K), q, v).withColumn("score", F.lit(0.0))


@query("vectors_by_label", "select label, count(*) as n from embeddings group by label")
def _(s, d):
    return t(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


# ---- metadata and index ----------------------------------------------------------------------

_FIELDS = ("title", "project_name", "agency", "file_name", "document_type", "notice_number")
_CLEAN = r"coalesce(regexp_replace(%s, '^\s+|\s+$', '', 'g'), '')"


@query("metadata_standard", f"""
select doc_id, {', '.join(f'{_CLEAN % c} as {c}' for c in ('file_name', *metadata.TEXT_FIELDS, 'source_path'))},
 case when regexp_replace(lower({_CLEAN % 'file_type'}), '^\\.+', '') <> '' then regexp_replace(lower({_CLEAN % 'file_type'}), '^\\.+', '') else lower(regexp_extract({_CLEAN % 'file_name'}, '[^./\\\\]\\.([^./\\\\]+)$', 1)) end as file_type, coalesce(source_exists, false) as source_exists from source_metadata""")
def _(s, d):
    return metadata.standard(t(s, d, "source_metadata"))


@query("metadata_problems", """
select count(*) as n_rows, count(*) filter (coalesce(trim(file_name), '') = '') as blank_file_name, count(*) filter (coalesce(trim(agency), '') = '') as blank_agency, count(*) filter (coalesce(trim(notice_number), '') = '') as blank_notice_number,
 count(doc_id) - count(distinct doc_id) as duplicated_doc_id, count(*) filter (not coalesce(source_exists, false)) as missing_sources from source_metadata""")
def _(s, d):
    return metadata.required_problems(t(s, d, "source_metadata"), ("file_name", "agency", "notice_number"))


_META_COLS = ("doc_id", "file_name", "project_name", "title", "agency", "document_type", "file_type", "notice_number", "notice_round", "budget", "summary")


@query("null_profile", " union all ".join(f"select '{c}' as field, count(*) filter ({c} is null) as n_null, count(*) filter (trim({c}) = '') as n_blank from source_metadata" for c in _META_COLS))
def _(s, d):
    return metadata.null_profile(t(s, d, "source_metadata").select(*_META_COLS))


@query("duplicated_projects", "select doc_id, project_name, n_same from (select doc_id, project_name, count(*) over (partition by project_name) as n_same from source_metadata) where n_same > 1")
def _(s, d):
    return metadata.duplicated(t(s, d, "source_metadata").select("doc_id", "project_name"), ["project_name"])


@query("metadata_unmatched", """
with a as (select distinct doc_id from source_metadata), b as (select distinct doc_id from sample_chunks)
select doc_id, 'left' as side from a where doc_id not in (select doc_id from b where doc_id is not null) union all select doc_id, 'right' from b where doc_id not in (select doc_id from a where doc_id is not null)""")
def _(s, d):
    return metadata.unmatched(t(s, d, "source_metadata"), t(s, d, "sample_chunks"), "doc_id")


@query("metadata_sync", f"""
select c.chunk_id, c.doc_id, coalesce(m.title, c.metadata['title']) as title, coalesce(m.agency, c.metadata['agency']) as agency, coalesce(m.notice_number, c.metadata['notice_number']) as notice_number, c.metadata['page_number'] as page_number
from {_CHUNKS} c join source_metadata m using (doc_id)""")
def _(s, d):
    m = metadata.merge_metadata(chunks_once(s, d), t(s, d, "source_metadata"), _FIELDS, strict=False)
    return m.select("chunk_id", "doc_id", *[F.col("metadata")[k].alias(k) for k in ("title", "agency", "notice_number", "page_number")])


@query("metadata_audit", f"""
with j as (select c.chunk_id, c.doc_id, c.metadata as x, m.* exclude (doc_id) from {_CHUNKS} c join source_metadata m using (doc_id))
select * from (select chunk_id, doc_id, {"case " + " ".join(f"when x['{f}'] is distinct from {f} then '{f}'" for f in _FIELDS) + " end as field"}, {"case " + " ".join(f"when x['{f}'] is distinct from {f} then x['{f}']" for f in _FIELDS) + " end as in_chunk"},
 {"case " + " ".join(f"when x['{f}'] is distinct from {f} then {f}" for f in _FIELDS) + " end as in_document"} from j) where field is not null""")
def _(s, d):
    return metadata.first_difference(chunks_once(s, d), t(s, d, "source_metadata"), _FIELDS)


def index_sides(s, d):
    """Two states of the index: what was delivered before August, and what was delivered from April on, of
    each chunk the latest; in the new state the texts are squeezed."""
    c = t(s, d, "sample_chunks")
    last = lambda x: x.groupBy("chunk_id").agg(F.max_by(F.struct("doc_id", "text", "metadata"), F.struct(F.coalesce("loaded_at", F.lit(0).cast("timestamp")))).alias("c")).select("chunk_id", "c.*")
    old = last(c.where("loaded_at < timestamp '2026-08-01 00:00:00'"))
    new = last(c.where("loaded_at >= timestamp '2026-04-01 00:00:00' or loaded_at is null"))
    return old, new.withColumn("text", fx.squeeze("text"))


_OLD = "(select chunk_id, first(doc_id) as doc_id, first(text) as text, first(metadata) as metadata from sample_chunks where loaded_at < timestamptz '2026-08-01 00:00:00+00' group by chunk_id)"
_NEW = f"(select chunk_id, first(doc_id) as doc_id, {_SQUEEZE % 'first(text)'} as text, first(metadata) as metadata from sample_chunks where loaded_at >= timestamptz '2026-04-01 00:00:00+00' or loaded_at is null group by chunk_id)"
_DIFF = f"""(select coalesce(n.chunk_id, o.chunk_id) as chunk_id, coalesce(n.doc_id, o.doc_id) as doc_id, case when o.chunk_id is null then 'added' when n.chunk_id is null then 'deleted' when o.text is not distinct from n.text then 'unchanged' else 'modified' end as change
from {_OLD} o full join {_NEW} n on o.chunk_id = n.chunk_id)"""


@query("index_diff", f"select * from {_DIFF}")
def _(s, d):
    return index.diff(*index_sides(s, d))


@query("index_diff_counts", f"""select {', '.join(f"count(*) filter (change = '{c}') as n_{c}" for c in ('unchanged', 'modified', 'added', 'deleted'))},
 (select count(*) from (select doc_id from {_DIFF} group by doc_id having bool_and(change = 'deleted'))) as n_deleted_docs from {_DIFF}""")
def _(s, d):
    return index.diff_counts(index.diff(*index_sides(s, d)))


# ---- evaluation ------------------------------------------------------------------------------

_SCORED = r"""(with r as (select distinct on (result_id) * from results_openai),
j as (select r.result_id, r.question_id, r.profile, r.question_type, r.response_seconds, r.final_answer, list_transform(regexp_extract_all(r.retrieved_doc_ids, '''([^'']*)'''), lambda x: replace(x, '''', '')) as got, coalesce(q.expected_doc_ids, []) as expected, coalesce(q.keywords, []) as keywords from r join questions q using (question_id)),
k as (select *, len(list_filter(keywords, lambda x: contains(coalesce(final_answer, ''), x))) as keyword_hit, len(keywords) as keyword_total from j)
select result_id, question_id, profile, question_type, response_seconds, case when len(expected) > 0 then list_has_any(expected, coalesce(got, [])) end as doc_hit, case when len(expected) > 0 then len(list_filter(coalesce(got, []), lambda x: list_contains(expected, x))) end as doc_hit_count,
 keyword_hit, keyword_total, """ + _SQUEEZE % "coalesce(final_answer, '')" + """ = '' as is_empty, case when keyword_total > 0 then keyword_hit / keyword_total::double end as hit_rate, keyword_hit = keyword_total as success from k)"""
_SUMMARY = """count(*) as n_results, count(doc_hit) as n_expected, count(*) filter (doc_hit) as n_doc_hit, sum(keyword_hit)::bigint as keyword_hit, sum(keyword_total)::bigint as keyword_total, count(*) filter (is_empty) as n_empty,
 round(avg(response_seconds), 4) as mean_seconds, round(avg(hit_rate), 4) as macro_hit_rate, round(avg(success::int), 4) as success_rate"""


def scored(s, d):
    return evaluation.score_results(t(s, d, "results_openai"), t(s, d, "questions"))


@query("eval_scores", f"select * from {_SCORED}")
def _(s, d):
    return scored(s, d)


@query("eval_summary", f"select {_SUMMARY} from {_SCORED}")
def _(s, d):
    return evaluation.summary(scored(s, d))


@query("eval_by_type", f"select profile, question_type, {_SUMMARY} from {_SCORED} group by all")
def _(s, d):
    return evaluation.summary(scored(s, d), "profile", "question_type")


@query("eval_trials", f"select profile, question_id, count(*) as n_trials, round(avg(hit_rate), 4) as mean_hit_rate, round(avg(success::int), 4) as success_rate, arg_min(response_seconds, result_id) as first_seconds from {_SCORED} group by all")
def _(s, d):
    return evaluation.trials(scored(s, d))


@query("eval_ceiling", "select profile, count(*) as n, count(*) filter (response_seconds >= 10) as n_at_ceiling, round(avg(coalesce((response_seconds >= 10)::int, null)), 6) as rate from (select distinct on (result_id) * from results_openai) group by profile")
def _(s, d):
    return evaluation.ceiling_rate(t(s, d, "results_openai").dropDuplicates(["result_id"]), "response_seconds", 10, "profile")


@query("eval_extrapolated", "select profile, count(response_seconds) as n, round(sum(response_seconds) / count(response_seconds) * 182, 6) as extrapolated from (select distinct on (result_id) * from results_openai) group by profile")
def _(s, d):
    return evaluation.extrapolated(t(s, d, "results_openai").dropDuplicates(["result_id"]), "response_seconds", 182, "profile")


@query("history_window", """
select question_id, conversation_id, turn_no, coalesce(string_agg(question || '=>' || coalesce(reference_answer, ''), chr(10)) over (partition by conversation_id order by turn_no, question_id rows between 3 preceding and 1 preceding), '') as history
from questions where conversation_id is not null""")
def _(s, d):
    q = t(s, d, "questions").where("conversation_id is not null").select("conversation_id", "turn_no", "question_id", "question", F.coalesce("reference_answer", F.lit("")).alias("answer"))
    h = evaluation.history(q)
    return h.select("question_id", "conversation_id", "turn_no", F.array_join(F.transform("history", lambda x: F.concat(x["question"], F.lit("=>"), x["answer"])), "\n").alias("history"))


@query("question_lookup", f"""
with k as (select {_SQUEEZE % 'question'} as k, min(question_id) as question_id from questions group by 1)
select r.result_id, k.question_id from (select distinct on (result_id) * from results_openai) r left join k on k.k = {_SQUEEZE % 'r.question'}""")
def _(s, d):
    r = t(s, d, "results_openai").dropDuplicates(["result_id"]).select("result_id", "question")
    return evaluation.lookup_question(r, t(s, d, "questions")).select("result_id", "question_id")


# ---- reports ---------------------------------------------------------------------------------


@query("length_describe", """
select coalesce(metadata['chunk_source'], 'body') as chunk_source, count(*) as n, round(avg(length(text)), 4) as mean, round(stddev_samp(length(text)), 4) as sd, min(length(text)) as least, round(quantile_cont(length(text), 0.25), 4) as q25, round(quantile_cont(length(text), 0.5), 4) as q50, round(quantile_cont(length(text), 0.75), 4) as q75, max(length(text)) as most,
 count(*) filter (length(text) > 800) as over_800, count(*) filter (length(text) > 1600) as over_1600, count(*) filter (contains(text, '|')) as with_pipe, count(*) filter (contains(text, chr(10))) as with_newline from """ + _CHUNKS + " where text is not null group by 1")
def _(s, d):
    return reports.text_lengths(chunks_once(s, d), F.coalesce(F.col("metadata")["chunk_source"], F.lit("body")))


@query("status_counts", "select source_type, vlm_status, count(*) as n from image_records group by all")
def _(s, d):
    return t(s, d, "image_records").groupBy("source_type", "vlm_status").agg(F.count("*").alias("n"))


@query("status_pivot", "select extraction_method, count(*) filter (status = 'extracted') as extracted, count(*) filter (status = 'review_required') as review_required, count(*) filter (status = 'duplicate') as duplicate, count(*) filter (status = 'failed') as failed from table_records group by extraction_method")
def _(s, d):
    return reports.pivot_counts(t(s, d, "table_records"), "extraction_method", "status", ["extracted", "review_required", "duplicate", "failed"])


@query("value_pivot", """with m as (select profile, question_type, round(avg(response_seconds), 4) as v from (select distinct on (result_id) * from results_openai) group by all)
select profile, max(v) filter (question_type = 'single') as single, max(v) filter (question_type = 'numeric') as numeric_type, max(v) filter (question_type = 'table') as table_type from m group by profile""")
def _(s, d):
    m = t(s, d, "results_openai").dropDuplicates(["result_id"]).groupBy("profile", "question_type").agg(F.round(F.avg("response_seconds"), 4).alias("v"))
    return reports.pivot_values(m, "profile", "question_type", "v", ["single", "numeric", "table"]).select("profile", "single", F.col("numeric").alias("numeric_type"), F.col("table").alias("table_type"))


@query("first_per_document", f"select doc_id, min(chunk_id) as chunk_id, count(*) as n_chunks from {_CHUNKS} group by doc_id")
def _(s, d):
    return reports.first_per_group(t(s, d, "sample_chunks").select("doc_id", "chunk_id").distinct(), "doc_id", "chunk_id", "n_chunks")


@query("documents_by_source", "select source, count(*) as n, count(distinct notice_number) as n_notices, sum(n_chars)::bigint as n_chars, arg_max(doc_id, n_chars * 10000000 - doc_id) as longest from documents group by source")
def _(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("notice_number").alias("n_notices"), F.sum("n_chars").alias("n_chars"), F.max_by("doc_id", F.col("n_chars") * 10000000 - F.col("doc_id")).alias("longest"))


@query("variant_deltas", """with m as (select date_trunc('month', answered_at at time zone 'UTC')::date as month, ((20 * sum(round(response_seconds * 1000)::bigint) + count(response_seconds)) // (2 * count(response_seconds))) / 10000.0 as v from (select distinct on (result_id) * from results_openai) where answered_at is not null group by 1)
select strftime(month, '%Y-%m') as month, v, round(v - lag(v) over (order by month), 6) as delta from m""")
def _(s, d):
    # means of decimals, so that the result does not hang on the order of the rows
    m = t(s, d, "results_openai").dropDuplicates(["result_id"]).where("answered_at is not null").groupBy(F.date_format("answered_at", "yyyy-MM").alias("month")).agg(F.round(F.avg(F.col("response_seconds").cast("decimal(18,6)")), 4).cast("double").alias("v"))
    return evaluation.deltas(m, "month", "v")


@query("assembled_documents", """with t as (select doc_id, count(distinct record_id) as n_tables from table_records group by doc_id), i as (select doc_id, count(*) as n_images from image_records group by doc_id), c as (select doc_id, count(distinct chunk_id) as n_chunks from sample_chunks group by doc_id)
select doc_id, coalesce(n_chunks, 0) as n_chunks, coalesce(n_tables, 0) as n_tables, coalesce(n_images, 0) as n_images from source_metadata left join c using (doc_id) left join t using (doc_id) left join i using (doc_id)""")
def _(s, d):
    count = lambda name, key, out: t(s, d, name).select("doc_id", key).distinct().groupBy("doc_id").agg(F.count("*").alias(out))
    m = t(s, d, "source_metadata").select("doc_id")
    for name, key, out in (("sample_chunks", "chunk_id", "n_chunks"), ("table_records", "record_id", "n_tables"), ("image_records", "record_id", "n_images")):
        m = m.join(count(name, key, out), "doc_id", "left").withColumn(out, F.coalesce(out, F.lit(0)))
    return m


_SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"


@query("table_in_body", f"""with b as (select doc_id, chunk_id, text from {_CHUNKS} where coalesce(metadata['chunk_source'], 'body') = 'body' and text is not null),
l as (select distinct record_id, doc_id, string_split_regex(table_markdown, '\\r\\n|\\n|\\r') as l from table_records where table_markdown is not null),
r as (select record_id, doc_id, case when regexp_matches(coalesce(l[2], ''), '{_SEPARATOR}') then l[3] else l[2] end as r from l),
p as (select record_id, doc_id, list_filter(list_transform(string_split(trim(r, '|'), '|'), lambda x: trim(x)), lambda x: length(x) >= 8)[1] as probe from r)
select record_id, probe, count(chunk_id) as n_chunks from p join b on b.doc_id = p.doc_id and contains(b.text, p.probe) group by record_id, probe""")
def _(s, d):
    b = collection(s, d).where((F.coalesce(F.col("metadata")["chunk_source"], F.lit("body")) == "body") & F.col("text").isNotNull()).select("doc_id", "chunk_id", "text")
    return reports.tables_in_body(tables_once(s, d), b)


@query("table_lookup", """with w as (select distinct doc_id, metadata['table_number']::int as table_number, chunk_id from sample_chunks where metadata['table_number'] is not null),
r as (select distinct record_id, doc_id, table_number, status from table_records)
select w.chunk_id, w.doc_id, w.table_number, r.record_id, r.status from w left join r on r.doc_id = w.doc_id and r.table_number = w.table_number""")
def _(s, d):
    wanted = collection(s, d).select("chunk_id", "doc_id", F.col("metadata")["table_number"].cast("int").alias("table_number")).where("table_number is not null")
    return wanted.join(tables_once(s, d).select("doc_id", "table_number", "record_id", "status"), ["doc_id", "table_number"], "left").select("chunk_id", "doc_id", "table_number", "record_id", "status")


@query("metadata_projection", """select doc_id, array_to_string(list_filter([%s], lambda x: x is not null), ';') as entries from source_metadata""" % ", ".join(f"'{k}=' || {c}" for c, k in metadata.CHUNK_KEYS))
def _(s, d):
    m = t(s, d, "source_metadata").select("doc_id", metadata.chunk_metadata().alias("m"))
    return m.select("doc_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("entries"))


@query("smoke_topk", f"""with {_BM25.replace(_ASKED, "(select * from (values %s) as v(query_id, query))" % ", ".join(f"('smoke_{i}', '{q}')" for i, q in enumerate(evaluation.SMOKE_QUESTIONS, 1)))} {_RANK % ('bm25', 3)}""")
def _(s, d):
    return retrieval.top_k(retrieval.bm25(evaluation.smoke_questions(s), chunk_index(s, d)), 3).select("query_id", "key", "score", "rank")


@query("expected_sets", """select question_id, array_to_string(list_sort(list_intersect(e, g)), ';') as found, array_to_string(list_sort(list_filter(e, lambda x: not list_contains(g, x))), ';') as missing
from (select question_id, list_distinct(coalesce(any_value(expected_doc_ids), [])) as e, list_distinct(flatten(list(coalesce(list_transform(regexp_extract_all(retrieved_doc_ids, '''([^'']*)'''), lambda x: replace(x, '''', '')), [])))) as g
from questions join results_openai using (question_id) group by question_id)""")
def _(s, d):
    g = t(s, d, "results_openai").select("question_id", F.explode(evaluation.list_literal("retrieved_doc_ids")).alias("doc")).distinct()
    asked_of = t(s, d, "results_openai").select("question_id").distinct()
    e = t(s, d, "questions").join(asked_of, "question_id", "left_semi").select("question_id", F.explode_outer(F.array_distinct("expected_doc_ids")).alias("doc"))
    j = e.join(g.withColumn("got", F.lit(True)), ["question_id", "doc"], "left")
    # the expected documents of one question
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("doc")))), ";")
    return j.groupBy("question_id").agg(pick(F.col("got").isNotNull()).alias("found"), pick(F.col("got").isNull() & F.col("doc").isNotNull()).alias("missing"))


@query("document_profile", """
with t as (select doc_id, count(distinct record_id) as n_tables from table_records group by doc_id), i as (select doc_id, count(distinct record_id) filter (source_type = 'page_scan') as n_empty_pages, count(distinct record_id) filter (source_type <> 'page_scan') as n_images from image_records group by doc_id),
d as (select doc_id, page_count as n_pages, coalesce(n_empty_pages, 0) as n_empty_pages, coalesce(n_tables, 0) as n_tables, coalesce(n_images, 0) as n_images from source_metadata left join t using (doc_id) left join i using (doc_id))
select *, case when n_pages is null then 'not_checked' when n_pages > 0 and n_empty_pages >= n_pages then 'ocr_required' when n_empty_pages > 0 then 'review_required' else 'not_required' end as reading,
 case when n_tables > 0 and n_images > 0 then 'table_and_image_review_required' when n_images > 0 then 'image_ocr_review_required' when n_tables > 0 then 'table_extraction_review_required' else 'not_required' end as visual from d""")
def _(s, d):
    return profile.document_profile(t(s, d, "source_metadata"), t(s, d, "table_records"), t(s, d, "image_records"))


@query("read_texts", """
select doc_id, count(*) as n_texts, sha256(string_agg(regexp_replace(ocr_text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by image_number, record_id)) as text_sha256 from image_records where vlm_status = 'applied' and trim(coalesce(ocr_text, '')) <> '' group by doc_id""")
def _(s, d):
    r = profile.read_texts(t(s, d, "image_records"))
    return r.select("doc_id", F.size("texts").alias("n_texts"), F.sha2(F.array_join("texts", "\n\n"), 256).alias("text_sha256"))
