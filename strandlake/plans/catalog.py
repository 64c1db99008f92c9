"""Queries that apply the operators to the driver's tables, each with its SQL.

The tables have no reads, strands or security events; each operator runs on
analogous columns (document texts as archive bytes, order lines as symbols of a
group, events as security events, conversations as extents with versions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..functions import sequences as S
from ..functions.statistics import wilson
from ..kernels import cauchy
from ..kernels.gf256 import MUL
from ..operators import archive, clustering, consensus, erasure, experiments, journal, ordered, planning, screening, security, tally
from .tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


# --- SQL fragments -----------------------------------------------------------------------------------------------

def _bases_sql(blob: str) -> str:
    out = f"translate(hex({blob}), '0123456789ABCDEF', 'abcdefghijklmnop')"
    for i, mark in enumerate("abcdefghijklmnop"):
        out = f"replace({out}, '{mark}', '{S.pair(i)}')"
    return out


_SEQ = _bases_sql("encode(coalesce(text, ''))")
_GC = "length(seq) - length(translate(seq, 'GC', ''))"
_RUN = "coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0)"
NT = 120
_STRANDS = f"""s0 AS (SELECT doc_id, lang, regexp_extract_all({_SEQ}, '.{{1,{NT}}}') AS parts FROM documents),
strands AS (SELECT doc_id, lang, unnest(parts) AS seq, generate_subscripts(parts, 1) - 1 AS pos FROM s0)"""
_WIN = "length(w) - length(translate(w, 'GC', ''))"


def _tandem_sql(period: int, most: int) -> str:
    same = f"array_to_string(list_transform(range(1, greatest(length(seq) - {period}, 0) + 1), lambda i: CASE WHEN substr(seq, i, 1) = substr(seq, i + {period}, 1) THEN '1' ELSE '0' END), '')"
    return f"contains({same}, '{'1' * (most - period + 1)}')"


RULES = screening.Rules(window=(40, 25, 75), tandem=8, motifs=("GAATTC", "GGATCC", "AAGCTT"), length=(100, 120))
#: Every 101st strand has a letter that is no base.
_STRAND = "CASE WHEN pos % 101 = 100 THEN 'X' || substr(seq0, 2) ELSE seq0 END"
_STRANDS = _STRANDS.replace("unnest(parts) AS seq,", "unnest(parts) AS seq0,").replace("strands AS (", "s1 AS (") + f""",
strands AS (SELECT doc_id, lang, pos, {_STRAND} AS seq FROM s1)"""
_BITS = [
    f"100 * ({_GC}) < 40 * length(seq) OR 100 * ({_GC}) > 60 * length(seq)",
    f"len(list_filter(list_transform(range(1, greatest(length(seq) - 39, 0) + 1), lambda i: substr(seq, i, 40)), lambda w: 100 * ({_WIN}) < 25 * 40 OR 100 * ({_WIN}) > 75 * 40)) > 0",
    "regexp_matches(seq, 'A{5}|C{5}|G{5}|T{5}')", f"{_tandem_sql(2, 8)} OR {_tandem_sql(3, 8)}", "regexp_matches(seq, 'GAATTC|GGATCC|AAGCTT')",
    "length(seq) NOT BETWEEN 100 AND 120", "NOT regexp_matches(seq, '^[ACGTN]*$')",
]
_V = " + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, rule in enumerate(_BITS))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _bytes():
    return F.encode(F.coalesce("text", F.lit("")), "UTF-8")


def _encoded(spark, sf_dir):
    return spread(_docs(spark, sf_dir).select("doc_id", "lang", "text")).select("doc_id", "lang", S.from_bytes(_bytes()).alias("seq"))


def _cut_strands(spark, sf_dir):
    strands = screening.strands(spread(_docs(spark, sf_dir).select("doc_id", "lang", "text")), _bytes(), NT, ["doc_id", "lang"])
    return strands.withColumn("seq", F.when(F.col("pos") % 101 == 100, F.concat(F.lit("X"), F.substring("seq", 2, 1 << 30))).otherwise(F.col("seq")))


# --- sequences and screening -------------------------------------------------------------------------------------

@query(f"""WITH e AS (SELECT lang, {_SEQ} AS seq FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(sum({_GC}) AS BIGINT) AS n_gc, CAST(max({_RUN}) AS BIGINT) AS longest_run FROM e GROUP BY lang""")
def strand_summary(spark, sf_dir):
    docs = spread(_docs(spark, sf_dir).select("lang", _bytes().alias("data"))).select("lang", tally.composition(F.col("data")).alias("c"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("c.n_bases").alias("n_bases"), F.sum("c.n_gc").alias("n_gc"), F.max("c.longest_run").alias("longest_run"))


@query(f"SELECT doc_id, md5({_SEQ}) AS seq_md5, length({_SEQ}) AS n_bases FROM documents")
def dna_encode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.length("seq").cast("long").alias("n_bases"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(text, '') = '' OR doc_id % 7 <> 0 AS same FROM documents")
def dna_decode(spark, sf_dir):
    """Texts as bases and back; in every seventh the first base was exchanged meanwhile."""
    back = F.arrow_udf(registry.dna_decode, "binary")
    seq = F.col("seq")
    spoilt = F.when(F.col("doc_id") % 7 == 0, F.concat(F.translate(F.substring(seq, 1, 1), "ACGT", "CGTA"), F.substring(seq, 2, 1 << 30))).otherwise(seq)
    rows = spread(_docs(spark, sf_dir).select("doc_id", _bytes().alias("data"))).withColumn("seq", S.from_bytes(F.col("data")))
    return rows.select("doc_id", F.md5(back(seq)).alias("text_md5"), (back(spoilt) == F.col("data")).alias("same"))


@query(f"SELECT doc_id, md5(reverse(translate({_SEQ}, 'ACGTN', 'TGCAN'))) AS rc_md5 FROM documents")
def reverse_complement(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.md5(S.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


@query(f"WITH e AS (SELECT doc_id, {_SEQ} AS seq FROM documents) SELECT doc_id, length(seq) AS n, {_GC} AS n_gc FROM e")
def gc_stats(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.length("seq").cast("long").alias("n"), S.gc(F.col("seq")).cast("long").alias("n_gc"))


@query(f"WITH e AS (SELECT doc_id, {_SEQ} AS seq FROM documents) SELECT doc_id, CAST({_RUN} AS BIGINT) AS longest_run FROM e")
def homopolymer_runs(spark, sf_dir):
    docs = spread(_docs(spark, sf_dir).select("doc_id", _bytes().alias("data")))
    return docs.select("doc_id", tally.composition(F.col("data"))["longest_run"].alias("longest_run"))


@query(f"WITH {_STRANDS}, v AS (SELECT doc_id, pos, {_V} AS v FROM strands) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(v AS BIGINT) AS violations FROM v WHERE v > 0")
def constraint_screen(spark, sf_dir):
    out = screening.screen(_cut_strands(spark, sf_dir), RULES).where("violations > 0")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("violations").cast("long").alias("violations"))


@query(f"""WITH {_STRANDS}, v AS (SELECT lang, {_V} AS v FROM strands) SELECT lang, count(*) AS n_strands, count(*) FILTER (v = 0) AS n_satisfied,
{', '.join(f"CAST(sum((v >> {i}) & 1) AS BIGINT) AS n_{n}" for i, n in enumerate(screening.ORDER))} FROM v GROUP BY lang""")
def violation_summary(spark, sf_dir):
    return screening.summary(screening.screen(_cut_strands(spark, sf_dir), RULES), ["lang"])


@query(f"""WITH e AS (SELECT item_id, {_SEQ} AS seq FROM benchmark),
w AS (SELECT item_id, substr(seq, CAST(i AS BIGINT), 50) AS seq FROM e, unnest(range(1, greatest(length(seq) - 48, 1))) AS t(i))
SELECT e.item_id, count(w.seq) FILTER (100 * (length(w.seq) - length(translate(w.seq, 'GC', ''))) < 40 * 50 OR 100 * (length(w.seq) - length(translate(w.seq, 'GC', ''))) > 60 * 50) AS n_outside
FROM e LEFT JOIN w USING (item_id) GROUP BY e.item_id""")
def gc_window(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", S.from_bytes(_bytes()).alias("seq"))
    return items.select("item_id", S.windows_outside(F.col("seq"), 50, 40, 60).cast("long").alias("n_outside"))


@query("""SELECT count(*) AS n_reads, count(*) FILTER (n BETWEEN 500 AND 5000) AS n_kept, count(*) FILTER (n < 500) AS n_short, count(*) FILTER (n > 5000) AS n_long,
CAST(sum(CASE WHEN n BETWEEN 500 AND 5000 THEN n ELSE 0 END) AS BIGINT) AS bases_kept, CAST(sum(CASE WHEN n BETWEEN 500 AND 5000 THEN n - length(translate(text, 'N', '')) ELSE 0 END) AS BIGINT) AS n_unknown
FROM (SELECT text, length(text) AS n FROM documents)""")
def read_filter_stats(spark, sf_dir):
    return screening.read_statistics(_docs(spark, sf_dir), 500, 5000, "text")


@query("SELECT CAST(length(text) AS BIGINT) AS len, count(*) AS n FROM documents GROUP BY length(text)")
def length_histogram(spark, sf_dir):
    return screening.lengths(_docs(spark, sf_dir), "text").select(F.col("len").cast("long").alias("len"), "n")


@query("SELECT CAST(length(text) AS BIGINT) AS len, count(*) AS n FROM documents GROUP BY length(text) ORDER BY n DESC, len LIMIT 5")
def top_lengths(spark, sf_dir):
    return screening.top_lengths(_docs(spark, sf_dir), 5, "text").select(F.col("len").cast("long").alias("len"), "n")


# --- archives ------------------------------------------------------------------------------------------------------

_CHUNKS = """c0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).{1,256}') AS parts FROM documents),
c AS (SELECT doc_id, unnest(parts) AS data, generate_subscripts(parts, 1) - 1 AS pos FROM c0),
d AS (SELECT sha256(data) AS chunk_id, min(doc_id * 1000000 + pos) AS first, count(*) AS n_refs FROM c GROUP BY 1),
t AS (SELECT chunk_id, row_number() OVER (ORDER BY first) - 1 AS idx, n_refs FROM d)"""


def _chunks(spark, sf_dir):
    return archive.chunks(_docs(spark, sf_dir), "doc_id", "text")


@query(f"WITH {_CHUNKS} SELECT chunk_id, idx, n_refs FROM t")
def chunk_dedup(spark, sf_dir):
    return archive.dedup(_chunks(spark, sf_dir), "doc_id")


@query(f"WITH {_CHUNKS} SELECT c.doc_id, c.pos, t.idx FROM c JOIN t ON sha256(c.data) = t.chunk_id")
def chunk_refs(spark, sf_dir):
    refs = _chunks(spark, sf_dir)
    return archive.references(refs, archive.dedup(refs, "doc_id"), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), "idx")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents")
def file_digest(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(_bytes(), 256).alias("sha256"), F.octet_length(_bytes()).cast("long").alias("n_bytes"))


def _merkle_sql(depth: int = 24) -> str:
    out = ["l0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, sha256('\\x00'::BLOB || encode(coalesce(text, ''))) AS h FROM documents)"]
    for i in range(1, depth + 1):
        out.append(
            f"l{i} AS (SELECT pos, CASE WHEN r IS NULL THEN l ELSE sha256('\\x01'::BLOB || unhex(l) || unhex(r)) END AS h FROM (SELECT pos // 2 AS pos, max(h) FILTER (pos % 2 = 0) AS l, max(h) FILTER (pos % 2 = 1) AS r FROM l{i - 1} GROUP BY pos // 2))"
        )
    return f"WITH {', '.join(out)} SELECT h AS root, (SELECT count(*) FROM documents) AS n_leaves FROM l{depth}"


@query(_merkle_sql())
def merkle_root(spark, sf_dir):
    from ..operators.common import numbered

    leaves = numbered(_docs(spark, sf_dir).select("doc_id", archive.leaf(_bytes()).alias("hash")), ["doc_id"], "pos")
    return archive.merkle_root(archive.merkle_levels(leaves.select("pos", "hash")))


@query("SELECT doc_id, doc_id % 13 <> 0 AS verified FROM documents")
def merkle_proof(spark, sf_dir):
    """Every document's inclusion proof, folded to a root and compared with the tree's; every 13th text was changed after the tree was built."""
    from ..operators.common import numbered

    changed = F.when(F.col("doc_id") % 13 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.coalesce("text", F.lit("")))
    docs = _docs(spark, sf_dir).select("doc_id", archive.leaf(_bytes()).alias("hash"), archive.leaf(F.encode(changed, "UTF-8")).alias("now"))
    leaves = numbered(docs, ["doc_id"], "pos")
    levels = archive.merkle_levels(leaves.select("pos", "hash"))
    proofs = archive.merkle_proofs(levels, leaves)
    root = archive.merkle_root(levels).select("root")
    none = F.array().cast("array<struct<level:int,left:boolean,hash:string>>")
    joined = leaves.join(proofs, "pos", "left").join(F.broadcast(root))  # one row
    return joined.select("doc_id", (archive.proof_root(F.col("now"), F.coalesce("proof", none)) == F.col("root")).alias("verified"))


@query("""WITH p AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM conversations)
SELECT conv_id, turn, CAST(o AS BIGINT) AS "offset", CAST(n AS BIGINT) AS size FROM p""")
def extent_ranges(spark, sf_dir):
    return _extents(spark, sf_dir).select("conv_id", "turn", F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))


def _extents(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return archive.offsets(parts, ["conv_id"], ["turn"], "size")


@query("""WITH p AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM conversations),
x AS (SELECT conv_id, unnest(range(0, CAST(ceil(max(o + n) / 512.0) AS BIGINT))) AS idx FROM p GROUP BY conv_id)
SELECT p.conv_id, p.turn, x.idx, CAST(least(o + n, (idx + 1) * 512) - greatest(o, idx * 512) AS BIGINT) AS n_overlap FROM p JOIN x ON p.conv_id = x.conv_id AND o < (idx + 1) * 512 AND o + n > idx * 512 WHERE n > 0""")
def range_overlap(spark, sf_dir):
    ranges = _extents(spark, sf_dir).select("conv_id", "turn", F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("stop"))
    totals = ranges.groupBy("conv_id").agg(F.max("stop").alias("total")).where("total > 0")
    extents = totals.select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("total") / 512) - 1)).alias("idx"))
    out = archive.overlaps(ranges, extents, ["conv_id"], 512)
    return out.select("conv_id", "turn", "idx", (F.least("stop", (F.col("idx") + 1) * 512) - F.greatest("start", F.col("idx") * 512)).cast("long").alias("n_overlap"))


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents), b AS (SELECT doc_id, quality, md5(CASE WHEN quality = 0 THEN 'changed' ELSE d.text END) AS h FROM labels LEFT JOIN documents d USING (doc_id))
SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'FAILED' WHEN a.doc_id IS NULL THEN 'UNKNOWN' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'VERIFIED' ELSE 'MODIFIED' END AS status FROM a FULL JOIN b USING (doc_id)""")
def integrity_compare(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    base = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    now = table(spark, sf_dir, "labels").join(docs.select("doc_id", "text"), "doc_id", "left")
    now = now.select("doc_id", F.md5(F.when(F.col("quality") == 0, F.lit("changed")).otherwise(F.col("text")).cast("binary")).alias("h"))
    return archive.compared(base, now, "doc_id", "h")


# --- copies, votes, addresses ------------------------------------------------------------------------------------

def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("letter"), F.concat("l_returnflag", "l_linestatus").alias("payload"), F.col("l_quantity").cast("int").alias("symbol"))


@query("""WITH c AS (SELECT l_orderkey AS grp, l_returnflag || l_linestatus AS payload, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY n DESC) AS k, count(*) OVER (PARTITION BY grp) AS n_kinds FROM c), t AS (SELECT *, count(*) FILTER (k = 1) OVER (PARTITION BY grp) AS tied FROM r)
SELECT grp, payload, n, n_kinds FROM t WHERE k = 1 AND tied = 1""")
def majority_resolve(spark, sf_dir):
    return consensus.majority(_symbols(spark, sf_dir), ["grp"], "payload")


@query("SELECT l_orderkey AS grp, count(DISTINCT l_returnflag || l_linestatus) AS n_kinds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def conflicts(spark, sf_dir):
    return consensus.conflicts(_symbols(spark, sf_dir), ["grp"], "payload")


@query("SELECT o_orderkey AS grp FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_addresses(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grp"))
    return consensus.missing(orders, _symbols(spark, sf_dir), ["grp"])


def _hex4(c: str) -> str:
    return f"lpad(to_hex({c}), 8, '0')"


@query(f"""WITH m AS (SELECT {_hex4('o_orderkey')} AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
p AS (SELECT p_partkey AS id, {_hex4('p_partkey * 7')} AS key FROM part),
n AS (SELECT id, k FROM p, m WHERE {' + '.join(f"CAST(substr(k, {2 * i + 1}, 2) <> substr(key, {2 * i + 1}, 2) AS INT)" for i in range(4))} <= 1),
o AS (SELECT id, min(k) AS s FROM n GROUP BY id HAVING count(*) = 1)
SELECT p.id, p.key, CASE WHEN m.k IS NOT NULL THEN p.key ELSE o.s END AS snapped FROM p LEFT JOIN m ON m.k = p.key LEFT JOIN o ON o.id = p.id""")
def snap_address(spark, sf_dir):
    key = lambda c: F.lpad(F.hex(c), 8, "0")
    lacking = missing_addresses(spark, sf_dir).select(key(F.col("grp")).alias("key"))
    pending = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), key(F.col("p_partkey") * 7).alias("key"))
    return consensus.snap(pending, lacking, 4)


@query("""WITH c AS (SELECT l_orderkey AS grp, l_linenumber AS pos, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)
SELECT grp, pos, CASE WHEN a + n + r = 0 OR greatest(a, n, r) < 0.6 * (a + n + r) THEN 'N' WHEN a = greatest(a, n, r) THEN 'A' WHEN n = greatest(a, n, r) THEN 'N' ELSE 'R' END AS called, a + n + r AS n_votes FROM c""")
def position_vote(spark, sf_dir):
    return consensus.votes(_symbols(spark, sf_dir), ["grp", "pos"], alphabet=("A", "N", "R"))


@query("""WITH c AS (SELECT l_orderkey AS grp, l_returnflag AS letter, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT grp, letter, round((n + 0.5) / (sum(n) OVER (PARTITION BY grp) + 1.5), 9) AS p FROM c""")
def vote_soft(spark, sf_dir):
    return consensus.soft_votes(_symbols(spark, sf_dir), ["grp"], classes=3).withColumn("p", F.round("p", 9))


@query("""WITH e AS (SELECT l_orderkey AS grp, l_returnflag AS b, least(0.75, greatest(1e-6, pow(10.0, -l_quantity / 10.0))) AS e FROM lineitem),
s AS (SELECT grp, sum(CASE WHEN b = 'A' THEN ln(1 - e) ELSE ln(e / 2) END) AS a, sum(CASE WHEN b = 'N' THEN ln(1 - e) ELSE ln(e / 2) END) AS n, sum(CASE WHEN b = 'R' THEN ln(1 - e) ELSE ln(e / 2) END) AS r FROM e GROUP BY grp),
t AS (SELECT *, greatest(a, n, r) AS m, list_reverse_sort([a, n, r]) AS o FROM s), q AS (SELECT *, 1 / (exp(a - m) + exp(n - m) + exp(r - m)) AS p FROM t)
SELECT grp, CASE WHEN o[1] - o[2] < 1e-9 OR p < 0.6 THEN 'N' WHEN a = m THEN 'A' WHEN n = m THEN 'N' ELSE 'R' END AS called, round(p, 6) AS p FROM q""")
def vote_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("letter"), F.col("l_quantity").alias("q"))
    return consensus.weighted_votes(rows, ["grp"], "letter", "q", alphabet=("A", "N", "R")).withColumn("p", F.round("p", 6))


@query("""WITH b AS (SELECT l_orderkey AS grp, l_linenumber AS pos, min(l_partkey) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), x AS (SELECT l_orderkey AS grp, l_linenumber AS pos, min(l_partkey) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT * FROM b UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.grp = x.grp AND b.pos = x.pos)""")
def fill_only_merge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    part = lambda s: lines.where(F.col("l_linestatus") == s).groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("v"))
    return consensus.fill_only(part("F"), part("O"), ["grp", "pos"])


@query("""SELECT l_orderkey AS grp, l_partkey, l_suppkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 2""")
def capped_reads(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_partkey", "l_suppkey", "l_linenumber")
    return consensus.capped(rows, ["grp"], ["l_linenumber", "l_partkey", "l_suppkey"], 2)


# --- clustering ----------------------------------------------------------------------------------------------------

#: Every turn and an edited copy of it: the copy lacks letter 7, has an X at letter 20 and a Z at its end.
_TURNS = """turns0 AS (SELECT conv_id * 1000 + turn AS id, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS text FROM conversations),
turns AS (SELECT id, text FROM turns0 UNION ALL SELECT 1000000000 + id, substr(text, 1, 6) || substr(text, 8, 12) || 'X' || substr(text, 21) || 'Z' FROM turns0)"""
_SKETCH = _TURNS + """, k AS (SELECT DISTINCT id, substr(text, CAST(i AS BIGINT), 12) AS k FROM turns, unnest(range(1, greatest(length(text) - 10, 1))) AS t(i)),
h AS (SELECT id, CAST(('0x' || substr(md5(k), 1, 15)) AS BIGINT) AS hash FROM k), s AS (SELECT id, hash % 32 AS slot, min(hash) AS hash FROM h GROUP BY ALL)"""
_PAIRS = f"""{_SKETCH}, g AS (SELECT slot, hash FROM s GROUP BY ALL HAVING count(*) BETWEEN 2 AND 256),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS n_shared FROM s x JOIN s y USING (slot, hash) WHERE (slot, hash) IN (SELECT (slot, hash) FROM g) AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2)"""
_EDGES = f"""{_PAIRS}, v AS (SELECT a, b, levenshtein(x.text, y.text) AS distance, greatest(length(x.text), length(y.text)) AS m FROM c JOIN turns x ON x.id = a JOIN turns y ON y.id = b),
e AS (SELECT a, b, distance FROM v WHERE distance <= floor(0.3 * m))"""


def _turns(spark, sf_dir):
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "?")  # the SQL engine's distance counts bytes
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), plain.alias("text"))
    part = lambda a, n: F.substring("text", a, n)
    edited = F.concat(part(1, 6), part(8, 12), F.lit("X"), part(21, 1 << 30), F.lit("Z"))
    return turns.unionByName(turns.select((F.col("id") + 1_000_000_000).alias("id"), edited.alias("text")))


def _sketch(spark, sf_dir):
    return clustering.sketch(_turns(spark, sf_dir), "id", F.col("text"))


@query(f"WITH {_SKETCH} SELECT id, slot, hash FROM s")
def kmer_sketch(spark, sf_dir):
    return _sketch(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT a, b, n_shared FROM c")
def candidate_pairs(spark, sf_dir):
    return clustering.candidates(_sketch(spark, sf_dir), "id")


@query(f"WITH {_EDGES} SELECT a, b, CAST(distance AS BIGINT) AS distance FROM e")
def edit_verify(spark, sf_dir):
    out = clustering.verified(candidate_pairs(spark, sf_dir), _turns(spark, sf_dir), "id", "text")
    return out.select("a", "b", F.col("distance").cast("long").alias("distance"))


@query(f"""WITH RECURSIVE {_EDGES.replace(', k AS (', ', k AS MATERIALIZED (', 1)}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, b AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a)
SELECT node, least(node, min(other)) AS root FROM r GROUP BY node""")
def components(spark, sf_dir):
    return clustering.components(edit_verify(spark, sf_dir).select("a", "b"))


# --- erasure codes ---------------------------------------------------------------------------------------------------

K, M = 7, 2


def _numbered_symbols(spark, sf_dir):
    rows = _symbols(spark, sf_dir).where(F.col("pos") <= K)
    return rows.groupBy("grp", (F.col("pos") - 1).alias("number")).agg(F.min("symbol").alias("symbol"))


_N = f"n AS (SELECT l_orderkey AS grp, l_linenumber - 1 AS number, CAST(min(l_quantity) AS INT) AS symbol FROM lineitem WHERE l_linenumber <= {K} GROUP BY ALL)"


def _times_sql(symbol: str, factor: int) -> str:
    out = "0"
    for b in range(8):
        out = f"xor({out}, CASE WHEN (({symbol}) >> {b}) & 1 = 1 THEN {int(MUL[factor, 1 << b])} ELSE 0 END)"
    return out


def _row_sql(i: int) -> str:
    c = cauchy.matrix(K, M)
    return "CASE number " + " ".join(f"WHEN {j} THEN {_times_sql('symbol', int(c[i, j]))}" for j in range(K)) + " END"


@query("SELECT l_orderkey AS grp, bit_xor(CAST(l_quantity AS INT)) AS parity, count(*) AS n_symbols FROM lineitem GROUP BY 1")
def xor_parity(spark, sf_dir):
    return erasure.xor_parity(_symbols(spark, sf_dir), ["grp"], "symbol")


@query(f"WITH {_N} SELECT grp, bit_xor({_row_sql(0)}) AS p0, bit_xor({_row_sql(1)}) AS p1 FROM n GROUP BY grp")
def gf256_parity(spark, sf_dir):
    return erasure.parity_rows(_numbered_symbols(spark, sf_dir), ["grp"], "number", "symbol", K, M)


@query(f"""WITH {_N}, full_groups AS (SELECT grp FROM n GROUP BY grp HAVING count(*) = {K})
SELECT n.grp, n.number, n.symbol FROM n JOIN full_groups USING (grp) WHERE n.number = n.grp % {K}""")
def gf256_recover_one(spark, sf_dir):
    """Symbol grp mod K of each full group is taken away and recovered from the first parity row."""
    symbols = _numbered_symbols(spark, sf_dir)
    full = symbols.groupBy("grp").count().where(F.col("count") == K).select("grp")
    whole = symbols.join(full, "grp")
    parities = erasure.parity_rows(whole, ["grp"], "number", "symbol", K, 1)
    left = whole.where(F.col("number") != F.col("grp") % K)
    return erasure.recover_one(left, parities, ["grp"], "number", "symbol", K).select("grp", F.col("number").cast("int").alias("number"), F.col("symbol").cast("int").alias("symbol"))


# --- events ----------------------------------------------------------------------------------------------------------

DAY = 86_400


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _range(days: float, key: str = "user_id") -> str:
    return f"PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {int(days * DAY)} SECONDS PRECEDING AND CURRENT ROW"


@query(f"SELECT event_id, user_id, n_window FROM (SELECT *, count(*) OVER ({_range(3)}) AS n_window FROM events WHERE event_type = 'error') WHERE n_window >= 5")
def rate_detector(spark, sf_dir):
    errors = _events(spark, sf_dir).where(F.col("event_type") == "error")
    return security.bursts(errors, ["user_id"], "ts", 3 * DAY, 5).select("event_id", "user_id", "n_window")


@query(f"SELECT event_id, user_id, n_distinct FROM (SELECT *, count(DISTINCT props) OVER ({_range(3)}) AS n_distinct FROM events) WHERE n_distinct > 10")
def enumeration_detector(spark, sf_dir):
    return security.enumerations(_events(spark, sf_dir), ["user_id"], "ts", "props", 3 * DAY, 10)


@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, count(*) OVER ({_range(3)}) AS n FROM events WHERE event_type = 'error') WHERE n >= 5),
r AS (SELECT user_id, event_id, ts AS last, k, true AS fire FROM f WHERE k = 1 UNION ALL
SELECT f.user_id, f.event_id, CASE WHEN f.ts - r.last >= INTERVAL {3 * DAY} SECONDS THEN f.ts ELSE r.last END, f.k, f.ts - r.last >= INTERVAL {3 * DAY} SECONDS FROM r JOIN f ON f.user_id = r.user_id AND f.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE fire""")
def once_per_window(spark, sf_dir):
    errors = _events(spark, sf_dir).where(F.col("event_type") == "error")
    return security.once_per_window(security.bursts(errors, ["user_id"], "ts", 3 * DAY, 5), ["user_id"], "ts", 3 * DAY)


_SEVERITY = "CASE event_type WHEN 'error' THEN 20 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 50 ELSE 0 END"


def _findings(spark, sf_dir):
    s = F.when(F.col("event_type") == "error", "MEDIUM").when(F.col("event_type") == "purchase", "LOW").when(F.col("event_type") == "signup", "HIGH").otherwise("INFO")
    return _events(spark, sf_dir).withColumn("severity", s)


@query(f"""WITH s AS (SELECT event_id, CAST(sum({_SEVERITY}) OVER ({_range(1)}) AS BIGINT) AS score FROM events)
SELECT event_id, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""")
def risk_score(spark, sf_dir):
    return security.risk(_findings(spark, sf_dir), ["user_id"], "ts", "severity", DAY).select("event_id", F.col("score").cast("long").alias("score"), "level")


@query(f"SELECT user_id, event_type, CAST(sum({_SEVERITY}) AS BIGINT) AS points FROM events GROUP BY ROLLUP (user_id, event_type) HAVING user_id IS NOT NULL")
def risk_breakdown(spark, sf_dir):
    return security.risk_breakdown(_findings(spark, sf_dir), "user_id", "event_type", "severity")


@query("""WITH f AS (SELECT *, first_value(user_id) OVER (PARTITION BY props ORDER BY ts, event_id) AS bound FROM events) SELECT event_id, user_id, bound FROM f WHERE user_id <> bound""")
def session_binding(spark, sf_dir):
    return security.session_changes(_events(spark, sf_dir), "props", "user_id", "ts").select("event_id", "user_id", "bound")


@query("""SELECT event_id, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id, props ORDER BY ts, event_id) + INTERVAL 86400 SECONDS, false) AS replay FROM events""")
def replay_guard(spark, sf_dir):
    return journal.replays(_events(spark, sf_dir), ["user_id", "props"], "ts", "86400 seconds").select("event_id", "replay")


_ANY = ["VERIFIED", "MODIFIED", "UNKNOWN", "FAILED"]
_POLICY = [
    (0, "deny", "*", "/en/1*", "write", ["VERIFIED"], "HIGH"), (1, "allow", "buyer", "/*", "extract", ["VERIFIED", "UNKNOWN"], "CRITICAL"), (2, "allow", "*", "/*", "list", _ANY, "MEDIUM"),
    (3, "allow", "*", "/*", "read", ["VERIFIED"], "LOW"), (4, "allow", "staff", "*", "write", ["VERIFIED", "MODIFIED"], "CRITICAL"), (5, "allow", "staff", "/en/?", "recover", _ANY, "CRITICAL"), (6, "allow", "*", "/*", "extract", ["VERIFIED"], "LOW"),
]
_OPERATION = "CASE event_type WHEN 'view' THEN 'list' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'extract' WHEN 'error' THEN 'write' ELSE 'recover' END"
_STATE = "CASE event_id % 8 WHEN 0 THEN 'DEGRADED' WHEN 1 THEN 'SUSPICIOUS' WHEN 2 THEN 'ISOLATED' WHEN 3 THEN 'RECOVERY' WHEN 4 THEN 'NONE' WHEN 5 THEN 'TRUSTED' ELSE 'VERIFIED' END"
_INTEGRITY = "CASE event_id % 5 WHEN 0 THEN 'MODIFIED' WHEN 1 THEN 'UNKNOWN' ELSE 'VERIFIED' END"


@query(f"""WITH rules(idx, effect, role, pattern, operation, integrity, max_risk) AS (VALUES {', '.join(f"({i}, '{e}', '{r}', '{p}', '{o}', {g}, {security.LEVELS.index(m)})" for i, e, r, p, o, g, m in _POLICY)}),
states(state, op) AS (VALUES {', '.join(f"('{st}', '{o}')" for st, ops in security.STATE_OPERATIONS.items() for o in ops)}),
q AS (SELECT event_id, {_OPERATION} AS op, {_STATE} AS state, {_INTEGRITY} AS integrity, CASE user_id % 3 WHEN 0 THEN 'buyer' WHEN 1 THEN 'staff' ELSE 'guest' END AS role, '/en/' || user_id AS res, CASE WHEN value > 20 THEN 2 WHEN value > 10 THEN 1 ELSE 0 END AS risk FROM events),
j AS (SELECT q.event_id, min(idx) FILTER (effect = 'deny') AS d, min(idx) FILTER (effect = 'allow' AND risk <= max_risk AND list_contains(rules.integrity, q.integrity)) AS a
FROM q LEFT JOIN rules ON (rules.role = '*' OR rules.role = q.role) AND operation = op AND res GLOB pattern AND (state, op) IN (SELECT (state, op) FROM states) GROUP BY 1)
SELECT event_id, d IS NULL AND a IS NOT NULL AS allowed, coalesce(d, a, -1) AS rule FROM j""")
def policy_decisions(spark, sf_dir):
    rules = spark.createDataFrame(_POLICY, "idx int, effect string, role string, resource string, operation string, integrity array<string>, max_risk string")
    user = F.col("user_id") % 3
    requests = table(spark, sf_dir, "events").select(
        "event_id", F.expr(_OPERATION).alias("req_operation"), F.expr(_STATE).alias("req_state"), F.expr(_INTEGRITY).alias("req_integrity"), F.when(user == 0, "buyer").when(user == 1, "staff").otherwise("guest").alias("req_role"),
        F.concat(F.lit("/en/"), F.col("user_id").cast("string")).alias("req_resource"), F.when(F.col("value") > 20, "HIGH").when(F.col("value") > 10, "MEDIUM").otherwise("LOW").alias("req_risk"),
    )
    return security.decide(requests, rules).withColumn("rule", F.coalesce("rule", F.lit(-1)))


_STATES = "CASE event_type WHEN 'view' THEN 'TRUSTED' WHEN 'click' THEN 'DEGRADED' WHEN 'error' THEN 'SUSPICIOUS' WHEN 'signup' THEN 'ISOLATED' ELSE 'INTEGRITY_CHECK' END"


@query(f"""WITH s AS (SELECT user_id, event_id, {_STATES} AS state, coalesce(lag({_STATES}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'TRUSTED') AS came_from FROM events)
SELECT event_id, state, came_from FROM s WHERE NOT ({' OR '.join(f"came_from = '{a}' AND state IN ({', '.join(repr(x) for x in [a, *b])})" for a, b in security.TRANSITIONS.items())})""")
def state_transitions(spark, sf_dir):
    state = F.expr(_STATES)
    out = security.forbidden_transitions(_events(spark, sf_dir).withColumn("state", state), "user_id", ["ts", "event_id"], "state")
    return out.select("event_id", "state", "came_from")


# --- journals ----------------------------------------------------------------------------------------------------------

@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def latest_version(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return journal.latest(rows, ["conv_id"], "turn")


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text_md5 FROM conversations WHERE turn <= 2 GROUP BY conv_id")
def snapshot_asof(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return journal.as_of(rows, ["conv_id"], "turn", 2)


@query("SELECT user_id, event_id, expected FROM (SELECT user_id, event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1, 0) AS expected FROM events) WHERE event_id <> expected")
def journal_gaps(spark, sf_dir):
    return journal.gaps(table(spark, sf_dir, "events"), ["user_id"], "event_id")


SECRET = b"a secret of the log, longer than one block of the digest that the codes are made with"


def _log(spark, sf_dir):
    return ordered.chained(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", SECRET)


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 50 = 0")
def audit_link_check(spark, sf_dir):
    """A log chained by keyed codes in which some payloads were changed afterwards: the links that do not fit."""
    changed = _log(spark, sf_dir).withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 50 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return journal.broken_links(changed, ["conv_id"], "turn", "text", SECRET)


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE conv_id % 10 WHEN 0 THEN CASE WHEN n = 1 THEN 'LOST' ELSE 'TRUNCATED' END WHEN 1 THEN 'REPLACED' ELSE 'EXTENDED' END AS state FROM n WHERE conv_id % 10 <= 2""")
def audit_anchor_check(spark, sf_dir):
    """Chains whose tail was cut, whose last code was replaced, or that grew, against anchors kept apart."""
    log, key = _log(spark, sf_dir), F.col("conv_id") % 10
    kept = journal.anchors(log, ["conv_id"], "turn")
    last = log.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    tail = log.join(last, "conv_id").where(~((key == 0) & (F.col("turn") == F.col("_last"))))
    mac = F.when((key == 1) & (F.col("turn") == F.col("_last")), F.lit("0")).otherwise(F.col("mac"))
    now = tail.select("conv_id", F.explode(F.when((key == 2) & (F.col("turn") == F.col("_last")), F.array("turn", F.col("turn") + 1)).otherwise(F.array("turn"))).alias("turn"), mac.alias("mac"))
    return journal.unanchored(now, kept, ["conv_id"], "turn")


@query("SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1")
def stream_digest(spark, sf_dir):
    """The digest of each conversation's text as one stream of bytes."""
    rows = ordered.running_digest(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")
    return rows.groupBy("conv_id").agg(F.max_by("sha256", "turn").alias("sha256"))


@query("""WITH e AS (SELECT conv_id, turn, (conv_id * 7 + turn) % 41 <> 0 AND (turn = 0 OR (conv_id + turn) % 37 <> 0) AS ok FROM conversations)
SELECT conv_id, count(*) FILTER (ok) AS n_valid, CASE WHEN min(turn) FILTER (NOT ok) IS NULL THEN 'CLEAN' WHEN min(turn) FILTER (NOT ok) = max(turn) THEN 'TORN_TAIL' ELSE 'CORRUPT' END AS state FROM e GROUP BY conv_id""")
def journal_records(spark, sf_dir):
    """Journal entries judged by their bytes: some checksums were spoilt, some numbers jump (and fall back)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("body"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("sum"))
    spoilt = F.when((F.col("conv_id") * 7 + F.col("turn")) % 41 == 0, F.col("sum") + 1).when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 37 == 0), F.lit(-1)).otherwise(F.col("sum"))
    return journal.torn_tail(journal.records(rows.withColumn("sum", spoilt), ["conv_id"], "turn", "body", "sum"), ["conv_id"], "turn", "valid")


@query("""SELECT conv_id, count(*) FILTER (ok) AS n_valid, CASE WHEN min(turn) FILTER (NOT ok) IS NULL THEN 'CLEAN' WHEN min(turn) FILTER (NOT ok) = max(turn) THEN 'TORN_TAIL' ELSE 'CORRUPT' END AS state
FROM (SELECT conv_id, turn, length(text) % 11 <> 0 AS ok FROM conversations) GROUP BY conv_id""")
def torn_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 11 != 0).alias("ok"))
    return journal.torn_tail(rows, ["conv_id"], "turn", "ok")


@query(f"""WITH s AS (SELECT event_id, user_id, event_type, ts, value, lead(ts) OVER w AS next_ts, lead(value) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT a.event_id, round(coalesce(sum(CASE WHEN b.next >= b.value THEN b.next - b.value ELSE b.next END), 0.0), 6) AS increase
FROM events a LEFT JOIN s b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts >= a.ts - INTERVAL {DAY} SECONDS AND b.next_ts <= a.ts GROUP BY a.event_id""")
def metric_increase(spark, sf_dir):
    """Growth of a counter over a day: steps between neighbouring samples, a step down being a reset to zero."""
    return journal.increase(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "value", DAY, "event_id").select("event_id", F.round("increase", 6).alias("increase"))


# --- experiments ---------------------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'CRASH' WHEN o_custkey % 7 = 0 THEN 'FALSE_SUCCESS' WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 5 = 0 OR o_custkey % 3 = 0 THEN 'CRASH' ELSE 'EXACT' END WHEN o_orderstatus = 'P' THEN 'PARTIAL'
ELSE CASE WHEN o_custkey % 3 > 0 THEN 'CRASH' ELSE 'EXPLICIT_FAILURE' END END AS outcome FROM orders""")
def outcome_class(spark, sf_dir):
    key, status = F.col("o_custkey"), F.col("o_orderstatus")
    claim = F.when(status == "F", "SUCCESS").when(status == "P", "PARTIAL").otherwise("FAILURE")
    out = experiments.outcome(F.col("o_orderpriority").startswith("1"), key % 7 == 0, claim, F.when(key % 5 == 0, 1).otherwise(0), key % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("outcome"))


_W = "1.959963984540054"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p, z2 = f"({k} * 1.0 / {n})", f"({_W} * {_W})"
    inner = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}) {sign} {_W} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n})) / (1 + {z2} / {n}))"
    return f"round({'greatest(0.0' if sign == '-' else 'least(1.0'}, CAST({inner} AS DOUBLE)), 4)"


@query(f"""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS rate,
{_wilson_sql("count(*) FILTER (o_orderstatus = 'F')", 'count(*)', '-')} AS low, {_wilson_sql("count(*) FILTER (o_orderstatus = 'F')", 'count(*)', '+')} AS high, round(quantile_cont(o_totalprice, 0.5), 6) AS median_seconds FROM orders GROUP BY 1""")
def sweep_curve(spark, sf_dir):
    out = experiments.curve(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], "F")
    return out.withColumns({"rate": F.round("rate", 9), "median_seconds": F.round("median_seconds", 6)})


@query(f"""WITH k AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, {_wilson_sql('k', 'n', '-')} AS low, {_wilson_sql('k', 'n', '+')} AS high FROM k""")
def wilson_ci(spark, sf_dir):
    low, high = wilson(F.count_if(F.col("o_orderstatus") == "F"), F.count("*"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(low.alias("low"), high.alias("high"))


@query("""WITH t AS (SELECT p_brand, p_partkey, (p_partkey * 37 % 1000 + 1) / 100000.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM t)
SELECT p_partkey, round(max(least(1.0, (n - k + 1) * p)) OVER (PARTITION BY p_brand ORDER BY k), 9) AS adjusted FROM r""")
def holm_adjust(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select("p_brand", "p_partkey", ((F.col("p_partkey") * 37 % 1000 + 1) / 100000.0).alias("p"))
    return experiments.holm(tests, ["p_brand"], "p", "p_partkey").select("p_partkey", F.round("adjusted", 9).alias("adjusted"))


@query("""WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, l_linenumber AS n, sum(l_extendedprice) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_suppkey AS s, l_partkey AS p, l_linenumber AS n, sum(l_extendedprice) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT n, count(*) AS n_pairs, round(exp(avg(ln(a.x / b.x))), 6) AS ratio FROM a JOIN b USING (s, p, n) WHERE a.x > 0 AND b.x > 0 GROUP BY n""")
def paired_ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda f: lines.where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n")).agg(F.sum("l_extendedprice").alias("x"))
    return experiments.paired_ratio(side("A"), side("R"), ["n"], ["s", "p"], "x").withColumn("ratio", F.round("ratio", 6))


@query("""WITH d AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))) FROM unnest(range(0, least(b, c) + 1)) AS t(i))) END, 9) AS p FROM d""")
def mcnemar(spark, sf_dir):
    runs = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").select("source", (F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y"))
    return experiments.discordant(runs, ["source"], "x", "y").withColumn("p", F.round("p", 9))


@query("SELECT l_returnflag, CAST(least(24, greatest(0, floor(l_quantity / 2.0))) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def rate_histogram(spark, sf_dir):
    return experiments.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 2.0, 25)


_TALLY = "t AS (SELECT l_suppkey AS ref, l_returnflag AS block, l_linenumber AS idx, count(*) AS cnt FROM lineitem GROUP BY ALL)"
_WEIGHTS = """r AS (SELECT ref, row_number() OVER (ORDER BY ref) - 1 AS number FROM (SELECT DISTINCT ref FROM t)),
w AS (SELECT ref, d.b, count(*) AS w FROM (SELECT b, CAST(('0x' || substr(md5(b || ':' || number), 1, 15)) AS BIGINT) % (SELECT count(*) FROM r) AS drawn FROM r, range(20) AS x(b)) d JOIN r ON r.number = d.drawn GROUP BY ALL)"""
_TOTALS = f"{_TALLY}, {_WEIGHTS}, x AS (SELECT b, block, idx, CAST(sum(w * cnt) AS BIGINT) AS total FROM t JOIN w USING (ref) GROUP BY ALL)"


@query(f"WITH {_TALLY} SELECT ref, block, idx, cnt FROM t")
def tally_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ref"), F.col("l_returnflag").alias("block"), F.col("l_linenumber").alias("idx"))
    return experiments.tally(rows, "ref", "block", "idx")


@query(f"WITH {_TOTALS} SELECT CAST(b AS INT) AS b, block, idx, total FROM x")
def bootstrap_totals(spark, sf_dir):
    tallies = tally_blocks(spark, sf_dir)
    return experiments.bootstrap_totals(tallies, experiments.bootstrap_weights(tallies.select("ref").distinct(), "ref", 20), "ref")


@query(f"WITH {_TOTALS} SELECT block, idx, round(quantile_cont(total, 0.025), 6) AS low, round(quantile_cont(total, 0.975), 6) AS high FROM x GROUP BY ALL")
def percentile_ci(spark, sf_dir):
    out = experiments.interval(bootstrap_totals(spark, sf_dir), ["block", "idx"], "total")
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("""WITH c AS (SELECT l_linenumber AS n, l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
d AS (SELECT n, abs(sum(a) OVER (PARTITION BY n ORDER BY v) / sum(a) OVER (PARTITION BY n) - sum(r) OVER (PARTITION BY n ORDER BY v) / sum(r) OVER (PARTITION BY n)) AS d FROM c) SELECT n, round(max(d), 9) AS ks FROM d GROUP BY n""")
def ks_distance(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "n")
    return experiments.ks_distance(lines, ["n"], "l_quantity", "l_returnflag", "A", "R").withColumn("ks", F.round("ks", 9))


@query("SELECT n_reads, count(*) AS n FROM (SELECT l_orderkey, count(*) AS n_reads FROM lineitem GROUP BY 1) GROUP BY 1")
def coverage_hist(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_reads")).groupBy("n_reads").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linenumber, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(coalesce(stddev_samp(l_extendedprice), 0.0), 4) AS sd, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL")
def trial_summary(spark, sf_dir):
    out = experiments.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice")
    return out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderkey), 1, 14)) AS BIGINT) AS seed FROM orders")
def trial_seeds(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", experiments.trial_seed(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderkey")).alias("seed"))


@query("""SELECT coalesce(o.o_orderkey, l.l_orderkey) AS k, o.o_totalprice AS recorded, l.s AS observed FROM (SELECT o_orderkey, round(o_totalprice) AS o_totalprice FROM orders) o FULL JOIN (SELECT l_orderkey, round(sum(l_quantity)) AS s FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey
WHERE o.o_totalprice IS DISTINCT FROM l.s""")
def recorded_diff(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").alias("v"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity")).alias("v"))
    return experiments.differences(a, b, ["k"], "v")


@query("SELECT 'events_total{type=\"' || event_type || '\",user=\"' || user_id || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id")
def metric_lines(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("value"))
    rows = counts.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("labels"), "value")
    return experiments.exposition(rows)


# --- plans -----------------------------------------------------------------------------------------------------------------

_VENDORS = [("alpha", "100.00", "0.050000", "0.000700", 350, 1), ("beta", "0.00", "0.090000", "0.001200", 300, 10), ("gamma", "2500.00", "0.001000", "0.000150", 400, 1000)]


@query(f"""WITH v(vendor, po, ps, pb, mx, mo) AS (VALUES {', '.join(f"('{a}', {b}::DECIMAL(18,6), {c}::DECIMAL(18,6), {d}::DECIMAL(18,6), {e}, {g})" for a, b, c, d, e, g in _VENDORS)}),
s AS (SELECT doc_id, strlen(coalesce(text, '')) AS size FROM documents), n AS (SELECT doc_id, size, CASE WHEN size = 0 THEN 0 ELSE (ceil(size / 2560.0) - 1) * 64 + ceil((size - (ceil(size / 2560.0) - 1) * 2560) / 40.0) + ceil(size / 2560.0) * 16 END + 12 AS k FROM s)
SELECT doc_id, vendor, CAST(k AS BIGINT) AS n_strands, 313 <= mx AND k >= mo AS fits, CASE WHEN 313 <= mx AND k >= mo THEN round(CAST(po + ps * CAST(k AS BIGINT) + pb * CAST(k * 313 AS BIGINT) AS DOUBLE), 6) END AS cost FROM n, v""")
def cost_plan(spark, sf_dir):
    vendors = spark.createDataFrame(_VENDORS, "vendor string, per_order string, per_strand string, per_base string, max_nt int, min_order int")
    vendors = vendors.withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("per_order", "per_strand", "per_base")})
    size = F.octet_length(_bytes()).cast("long")
    plans = _docs(spark, sf_dir).select("doc_id", planning.strands(size, 64, 16, 40).alias("n_strands"), F.lit(313).alias("nt"))
    return planning.cost(plans, vendors).select("doc_id", "vendor", "n_strands", "fits", F.round(F.col("cost").cast("double"), 6).alias("cost"))


_OPTIONS = [(k, m, p, round(planning.failure_bound(k + m, m, 0.1), 12)) for k in (32, 48, 64, 160) for m in (8, 16, 32, 48) for p in (36, 40, 44)]


@query(f"""WITH o(k, m, p, f) AS (VALUES {', '.join(map(str, _OPTIONS))}), s AS (SELECT doc_id AS id, strlen(coalesce(text, '')) AS size FROM documents),
c AS (SELECT id, CAST(ceil(size / (k * p * 1.0)) * (k + m) AS BIGINT) AS n_strands, k, m, p AS payload FROM s, o WHERE f <= 0.000001)
SELECT id, n_strands, k, m, payload FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n_strands, k, m, payload) = 1""")
def plan_geometry(spark, sf_dir):
    options = spark.createDataFrame(_OPTIONS, "k int, m int, payload int, failure double")
    sizes = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.octet_length(_bytes()).cast("long").alias("size"))
    return planning.geometry(sizes, options, 0.1, 1e-6)


@query("SELECT item_id AS file, sha256(text) AS sha256, true AS verified FROM benchmark")
def roundtrip_recovery(spark, sf_dir):
    """Benchmark items encoded, read through a simulated channel, decoded and verified."""
    from ..kernels.channel import Channel
    from . import codec

    items = table(spark, sf_dir, "benchmark")
    files = codec.manifest(items, "item_id", _bytes())
    strands = codec.encode(items, "item_id", _bytes())
    reads = codec.read(strands, Channel(seed=7, coverage=6.0))
    found = codec.recover(codec.resolve(codec.scan(reads)), files)
    return found.select("file", F.sha2("data", 256).alias("sha256"), "verified")


@query()
def channel_reads(spark, sf_dir):
    """Reads per item and length change: random draws have no SQL form."""
    from ..kernels.channel import Channel
    from . import codec

    items = table(spark, sf_dir, "benchmark")
    reads = codec.read(codec.encode(items, "item_id", _bytes()), Channel(seed=7, coverage=6.0))
    return reads.groupBy("file").agg(F.count("*").alias("n_reads"), F.sum(F.abs(F.length("seq") - 313)).cast("long").alias("length_change"))


FLAGSHIP = strand_summary

from . import more  # noqa: E402, F401  further queries
