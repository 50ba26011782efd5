"""The registered queries of this subpackage: thin calls over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, chat, collocations, embedding_dedup, exact_dedup, langid, licenses, minhash, packing, pii, toxicity
from .common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op9_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return chat.preference(turns, chat.neighbours(turns))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash_dedup, op3_embedding_dedup, op4_license_scan, op5_byte_bpe, op6_nearest_neighbours, op7_best_fit_packing, op8_pii, op9_chat_preferences, op10_language_id, op11_token_alignment, op12_exact_dedup, op13_collocations)}

#: Components of links (a, b) with the smallest id each node reaches, over nodes n.
_COMPONENTS = """
, walk(n, m) as (select n, n from nodes union select w.n, e.b from walk w join links e on e.a = w.m)
, root as (select n, min(m) r from walk group by n)
"""

_OP2 = (
    r"""
with recursive words as (
  select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents)
, grams as (
  select distinct doc_id, case when len(w) = 1 then w[1] else w[k] || chr(10) || w[k + 1] end s
  from words, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) t(k) where len(w) > 0)
, sizes as (select doc_id, count(*) n from grams group by doc_id)
, nodes as (select doc_id n from documents)
, shared as (select x.doc_id a, y.doc_id b, count(*) c from grams x join grams y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2)
, links as (select s.a, s.b from shared s join sizes p on p.doc_id = s.a join sizes q on q.doc_id = s.b where 100 * c >= 80 * (p.n + q.n - c))
"""
    + _COMPONENTS
    + """
select d.doc_id, coalesce(z.n, 0)::bigint n_shingles, root.r component_id, root.r = d.doc_id kept
from documents d left join sizes z using (doc_id) join root on root.n = d.doc_id
"""
)

_OP3 = (
    """
with recursive good as (
  select vec_id, label, embedding::double[] x, sqrt(list_sum(list_transform(embedding::double[], lambda v: v * v))) z
  from embeddings where label is not null and embedding is not null)
, nodes as (select vec_id n from embeddings)
, links as (
  select p.vec_id a, q.vec_id b from good p join good q on p.label = q.label and p.vec_id <> q.vec_id
  where p.z > 0 and q.z > 0 and list_inner_product(p.x, q.x) / (p.z * q.z) >= 0.98)
"""
    + _COMPONENTS
    + """
select e.vec_id, (select count(*) from links l where l.a = e.vec_id)::bigint n_links, root.r component_id, root.r = e.vec_id kept
from embeddings e join root on root.n = e.vec_id
"""
)


def _license_sql() -> str:
    """Containment over the same windows, by joining shingle texts instead of retrieving by min-hashes."""
    words = lambda src: f"select id, string_split(trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') w from ({src})"
    grams = lambda src: f"select id, k - 1 i, array_to_string(w[k : k + 4], ' ') s from ({src}), unnest(range(1, len(w) - 3)) u(k)"
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.TEMPLATES.items()))
    return f"""
with t as ({grams(words(f"select * from (values {values}) v(id, t)"))})
, n as (select id, count(distinct s) c, (2 ** ceil(log2(count(distinct s))))::bigint size from t group by id)
, tmpl as (select distinct t.id, t.s, n.c, n.size, greatest(1, n.size // 4) stride from t join n using (id))
, g as ({grams(words("select doc_id id, coalesce(text, '') t from documents"))})
, hit as (select g.id doc_id, g.i, tmpl.id license_id, g.s, c, size, stride, size + stride - 1 width from g join tmpl using (s))
, win as (
  select doc_id, license_id, k * stride as start_, count(distinct s)::double / any_value(c) share
  from hit, unnest(range(greatest(0, case when i < width then 0 else (i - width + stride) // stride end), i // stride + 1)) r(k)
  group by 1, 2, 3)
select doc_id, license_id, max(share) containment, min(start_)::int first_word, count(*)::bigint n_windows
from win where share * 100 >= 80 group by 1, 2
"""


_OP9 = """
with rows_ as (select distinct conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null and turn is not null)
, p as (select conv_id // 2 pair_id, case when conv_id % 2 = 0 then 'chosen' else 'rejected' end side, row_number() over (partition by conv_id order by turn, role, text) - 1 pos, role, text from rows_)
, m as (select pair_id, pos, count(*) n, min(role || chr(1) || text) a, max(role || chr(1) || text) b from p group by 1, 2)
, c as (select pair_id, min(case when n < 2 or a <> b then pos end) common from m group by 1)
, r as (
  select p.pair_id, case when common is null or pos < common then 'prompt' else side end part, pos, role,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) rendered,
    (common is not null and pos >= common and role = 'assistant')::int loss_mask
  from p join c using (pair_id) where side = 'chosen' or pos >= common)
select pair_id, part, pos, role, rendered, loss_mask,
  (sum(length(rendered)) over w - length(rendered))::bigint as "start", (sum(length(rendered)) over w)::bigint as "end"
from r window w as (partition by pair_id, part order by pos)
"""

ORACLE_SQL: dict[str, str] = {"op2_minhash_dedup": _OP2, "op3_embedding_dedup": _OP3, "op4_license_scan": _license_sql(), "op9_chat_preferences": _OP9, "op12_exact_dedup": exact_dedup.SQL, "op13_collocations": collocations.SQL}
