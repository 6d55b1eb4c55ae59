"""Registered queries of this subpackage: the operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cohorta.llm import bit_planes, fm_index, html_lstm, knn_join, license_diagonals, line_quality, pii_crf, pu_quality, raking, setsketch, spelling
from cohorta.llm import tool_calls, turn_repair
from cohorta.llm.registry import query, table
from cohorta.llm.words import PLAIN_PATTERN, SPACED_PATTERN
from cohorta.session import scratch_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '{PLAIN_PATTERN}')"
_SPACED = rf"regexp_extract_all({_LOWER}, '{SPACED_PATTERN}')"

OP1_SQL = f"""
with d as (select doc_id, {_PLAIN} as w from documents), i as (select item_id, {_PLAIN} as w from benchmark),
g as (select item_id, k, array_to_string(w[p : p + k - 1], ' ') as phrase from (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0)),
phrases as (select k, phrase, list(distinct item_id) as items from g group by all),
x as (select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') as phrase from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from phrases) where len(w) >= k)),
h as (select doc_id, p, k, items from x join phrases using (k, phrase)),
hit as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + k)) as q from h) group by 1),
found as (select doc_id, list_sort(list(distinct item::varchar)) as items from (select doc_id, unnest(items) as item from h) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
 sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
from d left join hit using (doc_id) left join found using (doc_id)"""

OP7_SQL = f"""
with recursive d as (select doc_id, {_SPACED} as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]) end)) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1), t as (select s.*, n from s join n using (doc_id)),
pairs as (select a.doc_id as x, b.doc_id as y, any_value(a.n) + any_value(b.n) as sizes, count(*) as c from t a join t b on a.g = b.g and a.doc_id < b.doc_id
 where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
link as (select x, y from pairs where 100 * c >= 80 * (sizes - c)), e as (select x, y from link union all select y, x from link),
r as (select doc_id as a, doc_id as b from d union select r.a, e.y from r join e on e.x = r.b)
select doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, c = doc_id as kept from d left join n using (doc_id) join (select a as doc_id, min(b) as c from r group by 1) using (doc_id)"""


@query("op1_fm_index", OP1_SQL)
def op1(spark, folder):
    found = fm_index.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def encode_documents(spark, docs):
    """Ids written to bit-plane files in the shared folder, and what is read back."""
    path = scratch_dir(spark)
    bit_planes.write_ids(docs, path, TOKENIZER)
    return bit_planes.read_documents(spark, path)


@query("op2_bit_planes")
def op2(spark, folder):
    return encode_documents(spark, table(spark, folder, "documents"))


@query("op3_line_quality")
def op3(spark, folder):
    judged = line_quality.line_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *(f"__lines.{c}" for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept content_share".split()))


@query("op4_raking")
def op4(spark, folder):
    return raking.mix(table(spark, folder, "documents")).select("doc_id", "__mix.*")


@query("op7_setsketch", OP7_SQL)
def op7(spark, folder):
    return setsketch.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_license_diagonals")
def op5(spark, folder):
    found = license_diagonals.scan_licenses(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


SCHEMAS = {"answer": {"query": ("string", True), "chars": ("integer", True, {"minimum": 0}), "system": ("boolean", False)}}


def with_tool_calls(conversations):
    """The table has no tool messages, so they are derived: each user turn also calls the
    tool ``answer``, building on the call of two turns before (every other one also on that of
    four turns before), and each assistant turn also is the result for the turn before."""
    called = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    arguments = F.struct(F.col("text").alias("query"), F.length("text").alias("chars"))
    after = F.when((F.col("turn") >= 4) & (F.col("turn") % 4 == 0), F.array(called(2), called(4))).when(F.col("turn") >= 2, F.array(called(2)))
    call = F.to_json(F.struct(F.lit("answer").alias("name"), called(0).alias("id"), arguments.alias("arguments"), after.alias("after")))
    result = F.to_json(F.struct(called(1).alias("id"), F.col("text").alias("content")))
    own = F.struct("role", "text")
    more = F.when(F.col("role") == "user", F.array(own, F.struct(F.lit("tool_call").alias("role"), call.alias("text"))))
    more = more.when(F.col("role") == "assistant", F.array(own, F.struct(F.lit("tool").alias("role"), result.alias("text")))).otherwise(F.array(own))
    return conversations.select("conv_id", "turn", F.inline(more))


@query("op6_tool_calls")
def op6(spark, folder):
    return tool_calls.format_chat(with_tool_calls(table(spark, folder, "conversations")), tool_calls.schema_table(spark, SCHEMAS))


@query("op8_pu_quality")
def op8(spark, folder):
    return pu_quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_html_lstm")
def op9(spark, folder):
    found = html_lstm.extract_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_pii_crf")
def op10(spark, folder):
    return pii_crf.spelled(pii_crf.scan_personal(table(spark, folder, "documents")))


OP11_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: coalesce(isfinite(x::double), false))) = len(embedding)),
ranked as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.e, d.e)::bigint as score
  from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from ranked qualify rank <= 5"""


@query("op11_voronoi_knn", OP11_SQL)
def op11(spark, folder):
    return knn_join.knn_join(table(spark, folder, "embeddings"), "vec_id % 50 = 0")


@query("op12_run_length_repair")
def op12(spark, folder):
    return turn_repair.repair_conversations(table(spark, folder, "conversations"))


@query("op13_trie_spelling")
def op13(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))
