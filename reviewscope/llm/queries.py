"""The registered queries of the training-data operators, each next to its oracle SQL where SQL can express it.

A query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewscope.llm import centroids, credentials, divergence, exact_dedup, language, minhash, mixing, packing, ppm, substrings, toxicity, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------ 8: mixing
WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP8_SQL = rf"""
with sizes as (
  select doc_id, source, cast({WORDS_SQL} as bigint) as size,
    (cast(('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint)::double + 0.5)
      / 4503599627370496.0 as u
  from documents
),
totals as (select source, sum(size)::bigint as words, count(*) as docs from sizes group by source),
weighed as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight,
    words::double * 3.0 as cap
  from totals
),
levels as (
  select *, (sum(words) over ()::double
      - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over ()
      - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from weighed
),
per as (select source, words, least(cap, max(level) over () * weight)::double as target from levels),
plans as (
  select *, floor(case when words > 0 then target / words else 0 end)::double as whole,
    greatest(target - floor(case when words > 0 then target / words else 0 end)::double * words, 0) as wanted
  from per
),
counts as (
  select s.source, size, wanted, count(*) * size as held, (count(*) * size)::hugeint * size as squares
  from sizes s join plans p on s.source is not distinct from p.source where size > 0 and wanted > 0 group by s.source, size, wanted
),
levels_of as (
  select source, size, wanted - coalesce(sum(held) over larger, 0) as left_words,
    (wanted - coalesce(sum(held) over larger, 0)) / (sum(squares) over (partition by source) - coalesce(sum(squares) over larger, 0))::double as c
  from counts window larger as (partition by source order by size desc rows between unbounded preceding and 1 preceding)
),
fair as (select source, max(size) as lim, arg_max(c, size) as c, arg_max(left_words, size) as left_words from levels_of where c * size <= 1 group by source),
ranked as (
  select s.doc_id, s.size, s.source, p.words, p.target, p.whole, f.lim, f.left_words,
    case when s.size > 0 and s.size <= f.lim then s.u * (1 - f.c * s.size) / (s.u * (1 - f.c * s.size) + f.c * s.size * (1 - s.u)) end as t
  from sizes s join plans p on s.source is not distinct from p.source left join fair f on s.source is not distinct from f.source
),
summed as (
  select *, sum(size) filter (t is not null) over (partition by source order by t range between unbounded preceding and current row)
    - sum(size) over (partition by source, t) / 2.0 as middle
  from ranked
)
select doc_id, size, words as source_size, target,
  cast(size * (whole + case when size > lim then 1 when t is not null and middle <= left_words then 1 else 0 end) as bigint) as taken
from summed
"""


@query("op8_mix_sources", OP8_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed to their target weights."""
    return mixing.allocate(table(spark, sf_dir, "documents")).drop("copies")


# --------------------------------------------------------------------------- 9: exact dedup
OP9_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  coalesce(doc_id = max(doc_id) over same, false) as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""


@query("op9_exact_dedup", OP9_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, size and verdict of every document; equal texts are one class."""
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------------ 7: packing
def tokenizer_text() -> str:
    """The tokenizer of the packing query, as its file's text."""
    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


@query("op7_pack_documents")
def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every token of every document lies in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_text())


# ---------------------------------------------------------------------------- 5: language ID
def held_out(key: Column, parts: int, part: int) -> Column:
    """Is the row in the held-out part, by crc32 of the key as text? A null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


@query("op5_identify_language")
def op5_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    found = language.predict(docs, language.fit(docs.filter(~out)), carry=["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score").withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")


# -------------------------------------------------------------------- 10: MinHash near-dedup
@query("op10_minhash_dedup")
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on sets of four-word shingles."""
    return minhash.classes(table(spark, sf_dir, "documents"), width=4)


# ---------------------------------------------------------------- 2: embedding near-dedup
@query("op2_near_vectors")
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.95."""
    return vectors.classes(table(spark, sf_dir, "embeddings"))


# ------------------------------------------------------------------------------ 4: LM scoring
@query("op4_score_documents")
def op4_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and word model scores of every document, learned from those that are not held out."""
    return ppm.score(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0))


# --------------------------------------------------------------------------- 1: secret scan
def spans_sql(kind: credentials.Kind) -> str:
    """The spans of a kind in DuckDB; `text` is the text."""
    # Possessive repeats only keep Java from recursing; they match the same.
    pattern = kind.pattern.replace("++", "+").replace("'", "''")
    hint = credentials.HINTS[kind.name].replace("'", "''")
    fits = " and ".join(f"regexp_matches(j[i], '{n}')" for n in kind.needs) or "true"
    return f"""
  select doc_id, {credentials.KINDS.index(kind)} as place, '{kind.name}' as kind,
    unnest([{{'start': s[i], 'end': s[i] + length(m[i])}} for i in range(1, len(m) + 1) if {fits}], recursive := true)
  from (
    select *, [list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) for i in range(1, len(m) + 1)] as s
    from (
      select doc_id, regexp_extract_all(text, '{pattern}', 0) as m, regexp_extract_all(text, '{pattern}', {kind.group}) as j,
        string_split_regex(text, '{pattern}') as g
      from texts where regexp_matches(text, '{hint}')
    )
  )"""


OP1_SQL = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
parts as ({" union all ".join(map(spans_sql, credentials.KINDS))}),
roles as (select *, ['secret', 'id', 'secret', 'id', 'secret', 'endpoint'][place + 1] as role from parts),
near as (
  select *, max(role = 'secret') over reach as near_secret, max(role = 'id') over reach as near_id
  from roles window reach as (partition by doc_id order by start range between {credentials.SCOPE} preceding and {credentials.SCOPE} following)
),
reported as (
  select *, case when place < 3 then true when role = 'secret' then near_id else near_secret end as said from near
),
lists as (
  select doc_id, count(*) filter (place = 0) as n_assign, count(*) filter (place = 1) as n_access, count(*) filter (place = 2) as n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || "end", ',' order by start, place) filter (place < 3), '') as base,
    coalesce(string_agg(kind || ':' || start || ':' || "end", ',' order by start, place) filter (said), '') as spans,
    count(*) filter (place >= 3 and said) as n_linked
  from reported group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked
from documents d left join lists l on d.doc_id = l.doc_id
"""


@query("op1_scan_secrets", OP1_SQL)
def op1_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, and the weak parts that belong to them."""
    found = credentials.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_linked")


# ---------------------------------------------------------------------------------- 6: WARC
OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from h)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from f
"""


@query("op6_warc_round_trip", OP6_SQL)
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is found in the archives that were written from the table."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


# ------------------------------------------------------------------------------ 3: toxicity
@query("op3_score_toxicity")
def op3_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learned from the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_sampled(docs, table(spark, sf_dir, "labels")))


# ------------------------------------------------------------------- 11: source divergence audit
OP11_SQL = rf"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
),
tokens as (select row, lang, source, unnest(terms) as term from d),
kept as (select lang, term from tokens group by all having count(distinct row) >= {divergence.LEAST}),
counts as (select lang, source, term, count(*) as n from tokens group by all),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n
  from (select distinct lang, source from d) g join kept k on g.lang = k.lang
  left join counts c on c.lang = k.lang and c.term = k.term and c.source = g.source
),
sums as (
  select *, sum(n) over (partition by lang, source) as total, count(*) over (partition by lang, source) as terms,
    sum(n) over (partition by lang, term) as n_all, sum(n) over (partition by lang) as everything
  from cells
),
p as (
  select lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * terms) as p,
    1 + (1000000000 * (n_all + 2)) // (everything + 2 * terms) as q
  from sums
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(v.value, 0) as value
  from (select distinct lang, source from d) a join (select distinct lang, source from d) b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
  ) v on v.lang = a.lang and v.source = a.source and v.item = b.source
),
rows as (
  select lang, source, 'pair' as part, item, value::bigint as value from pairs
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p where n > 0 and p > q
),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from rows)
select * from ranked where part = 'pair' or rank <= {divergence.TOP}
"""


@query("op11_audit_sources", OP11_SQL)
def op11_audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the words that set each apart from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------- 12: substring dedup
OP12_SQL = rf"""
with d as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select row, doc_id, i, array_to_string(words[i:i + {substrings.WINDOW} - 1], ' ') as text
  from (select *, unnest(range(1, len(words) - {substrings.WINDOW} + 2)) as i from d)
),
firsts as (select text, min(doc_id) as first from windows group by text),
gone as (
  select distinct row, i + k as place
  from (select row, i, unnest(range(0, {substrings.WINDOW})) as k from windows join firsts using (text) where doc_id > first)
),
placed as (select row, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from d),
kept as (
  select p.row, string_agg(word, ' ' order by place) filter (g.place is null) as text, count(g.place) as n
  from placed p left join gone g using (row, place) group by p.row
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (row)
"""


@query("op12_strip_substrings", OP12_SQL)
def op12_strip_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that an earlier one has too."""
    return substrings.strip(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------- 13: centroid clustering
def op13_sql() -> str:
    """Every round is a table of assignments and one of centroids, both in long form."""
    d = centroids.DIMENSIONS
    parts = [
        f"""
v as materialized (
  select row_number() over () as row, vec_id, [floor({centroids.SCALE} * x::double)::bigint for x in embedding] as v
  from embeddings
  where len(embedding) = {d} and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
cells as materialized (select row, unnest(v) as x, unnest(range(1, {d} + 1)) as dim from v),
c0 as materialized (
  select cluster, unnest(v) as c, unnest(range(1, {d} + 1)) as dim
  from (select v, (row_number() over (order by sha256('{centroids.SEED}:' || coalesce(vec_id::varchar, 'null')), v) - 1)::int as cluster from v)
  where cluster < {centroids.CLUSTERS}
)"""
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"""
a{i} as materialized (
  select row, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance
  from (select row, cluster, sum((x - c) * (x - c))::bigint as distance from cells join c{i} using (dim) group by all)
  group by row
)""")
        if i < centroids.ROUNDS:
            parts.append(f"""
c{i + 1} as materialized (
  select cluster, coalesce(mean, c) as c, dim
  from c{i} left join (
    select cluster, dim, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as mean from cells join a{i} using (row) group by all
  ) using (cluster, dim)
)""")
    return f"""
with {",".join(parts)}
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  name as centroid_sha256, count(*) over (partition by cluster) as cluster_size
from a{centroids.ROUNDS} join v using (row) join (
  select cluster, sha256(string_agg(c::bigint::varchar, ',' order by dim)) as name from c{centroids.ROUNDS} group by cluster
) using (cluster)
"""


@query("op13_cluster_centroids", op13_sql())
def op13_cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after the rounds, on whole numbers."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
