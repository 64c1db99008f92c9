"""Further queries of the catalog: formats, pools, findings, tallies, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import archive, consensus, experiments, pools, screening, security, stripes, tally, taxonomy
from .archives import with_offsets
from .catalog import _SEQ, _STRANDS, _V, RULES, _bytes, _cut_strands, _docs, _encoded, _events, _symbols, candidate_pairs, query
from .catalog import _PAIRS as PAIRS_SQL
from .tables import spread, table

# --- small formats --------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 + 524288 WHEN 3 THEN p_size * 1073741824 WHEN 4 THEN NULL WHEN 5 THEN p_size * 1099511627776 ELSE p_size END AS n_bytes
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""")
def size_texts(spark, sf_dir):
    """Sizes in words, read back as bytes."""
    n = F.col("p_size").cast("string")
    words = F.element_at(F.array(n, F.concat(n, F.lit("KiB")), F.concat(n, F.lit(".5 mb")), F.concat(F.lit(" "), n, F.lit("GB ")), F.concat(n, F.lit("XB")), F.concat(n, F.lit("tib")), F.concat(n, F.lit(".0 B"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.size_bytes(words).alias("n_bytes"))


@query("""WITH v AS (SELECT p_brand, p_size % 12 AS a, p_partkey % 11 AS b, p_partkey % 13 AS c, p_partkey % 5 = 0 AS pre FROM part)
SELECT p_brand, a || '.' || b || '.' || c || CASE WHEN pre THEN '-rc' ELSE '' END AS version FROM (SELECT DISTINCT * FROM v) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY a DESC, b DESC, c DESC, pre) = 1""")
def latest_models(spark, sf_dir):
    version = F.concat(F.concat_ws(".", F.col("p_size") % 12, F.col("p_partkey") % 11, F.col("p_partkey") % 13), F.when(F.col("p_partkey") % 5 == 0, "-rc").otherwise(""))
    return pools.latest_versions(table(spark, sf_dir, "part").select("p_brand", version.alias("version")), "p_brand", "version")


@query("""SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'component' WHEN 1 THEN 'unsafe' WHEN 2 THEN 'component' WHEN 3 THEN 'unsafe' WHEN 4 THEN 'length' WHEN 5 THEN 'control' WHEN 6 THEN 'length' END AS fault FROM pages""")
def path_faults(spark, sf_dir):
    """Archive paths made of urls, most of them spoilt in one way or another."""
    own = F.concat(F.lit("a/"), F.regexp_replace(F.coalesce("url", F.lit("u")), "[^a-z0-9]+", "-"))
    spoilt = F.array(F.concat(F.lit("../"), own), F.concat(F.lit("/"), own), F.concat(own, F.lit("//x")), F.concat(own, F.lit("\\x")), F.lit(""), F.concat(own, F.lit("\t")), F.repeat(F.concat(own, F.lit("é")), 2000), own, F.concat(own, F.lit("/é..x")))
    return table(spark, sf_dir, "pages").select("page_id", T.path_fault(F.element_at(spoilt, (F.col("page_id") % 9 + 1).cast("int"))).alias("fault"))


@query("""SELECT event_id, md5('{"a":"' || event_type || '","k":"' || regexp_extract(props, '"k": ([0-9]+)', 1) || '","user":"' || user_id || '"}') AS digest FROM events""")
def canonical_props(spark, sf_dir):
    """Digests of documents whose keys came in different orders."""
    own = F.from_json("props", "map<string,string>")
    more = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))).otherwise(F.create_map(F.lit("a"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.md5(T.canonical_map(F.map_concat(own, more)).cast("binary")).alias("digest"))


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def document_values(spark, sf_dir):
    nested = F.concat(F.lit('{"stage": {"rates": '), F.col("props"), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", T.path_value(nested, "stage.rates.k").cast("bigint").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 6 >= 3 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS second FROM events")
def utc_stamps(spark, sf_dir):
    """Stamps as text; half of them are no UTC stamps."""
    good = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fraction = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    words = F.array(F.replace(good, F.lit("Z"), F.lit("+00:00")), F.replace(good, F.lit("T"), F.lit(" ")), F.replace(good, F.lit("-0"), F.lit("-9")), good, fraction, good)
    stamp = T.utc_stamp(F.element_at(words, (F.col("event_id") % 6 + 1).cast("int")))
    return _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 6 == 2, F.lit(None).cast("bigint")).otherwise(F.floor(F.unix_micros(stamp) / 1_000_000)).alias("second"))


@query("""WITH s AS (SELECT p_partkey, p_partkey % 4 AS kind, p_size / 100.0 AS a, p_size / 200.0 AS b FROM part)
SELECT p_partkey, 0::BIGINT AS point, 'substitution' AS name, CAST(a AS DOUBLE) AS rate FROM s WHERE kind = 0 UNION ALL SELECT p_partkey, 1, 'substitution', CAST(b AS DOUBLE) FROM s WHERE kind = 0
UNION ALL SELECT p_partkey, 0, 'insertion', CAST(a AS DOUBLE) FROM s WHERE kind = 1 UNION ALL SELECT p_partkey, 0, 'deletion', CAST(b AS DOUBLE) FROM s WHERE kind = 1""")
def sweep_specs(spark, sf_dir):
    """Points of written sweeps; two of four kinds are refused."""
    a, b = ((F.col("p_size") / n).cast("string") for n in (100, 200))
    words = F.array(F.concat(F.lit(" Substitution="), a, F.lit(", "), b), F.concat(F.lit("mixed=insertion:"), a, F.lit("+deletion:"), b), F.concat(F.lit("deletion="), a, F.lit(",1.5")), F.concat(F.lit("deletion "), a))
    points = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.sweep_points(F.element_at(words, (F.col("p_partkey") % 4 + 1).cast("int")))).alias("point", "all"))
    return points.select("p_partkey", F.col("point").cast("bigint").alias("point"), F.explode("all").alias("x")).select("p_partkey", "point", "x.name", "x.rate")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) + l_linenumber + l_partkey % 3 + 1 + 5 AS ref_len, CAST(l_quantity AS BIGINT) + l_linenumber + l_suppkey % 4 + 1 + 5 AS read_len, 5::INT AS n_runs FROM lineitem""")
def cigar_lengths(spark, sf_dir):
    part = lambda n, op: F.concat(n.cast("string"), F.lit(op))
    words = F.concat(part(F.col("l_quantity").cast("int"), "="), part(F.col("l_linenumber"), "X"), part(F.col("l_partkey") % 3 + 1, "D"), part(F.col("l_suppkey") % 4 + 1, "I"), F.lit("5="))
    rows = table(spark, sf_dir, "lineitem").withColumn("r", T.cigar_runs(words))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.cigar_length(F.col("r"), "=XDNM").alias("ref_len"), T.cigar_length(F.col("r"), "=XISM").alias("read_len"), F.size("r").alias("n_runs"))


# --- pools ------------------------------------------------------------------------------------------------------------

_CHUNK_ROWS = """t0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, CAST(strlen(coalesce(text, '')) AS BIGINT) AS stored, doc_id FROM documents),
t1 AS (SELECT idx, stored, CAST(coalesce(sum(stored) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + CASE WHEN idx % 89 = 7 THEN 1 ELSE 0 END AS "offset" FROM t0),
t AS (SELECT * FROM t1 WHERE idx % 97 <> 50)"""


@query(f"""WITH {_CHUNK_ROWS}, p AS (SELECT *, lag(idx) OVER (ORDER BY idx) AS before, lag("offset" + stored) OVER (ORDER BY idx) AS ends FROM t)
SELECT count(*) AS n_chunks, count(*) FILTER (before <> idx - 1) AS n_gaps, count(*) FILTER (before <> idx - 1 OR ends <> "offset" OR (idx = 0 AND "offset" <> 0)) AS n_breaks FROM p""")
def chunk_table_check(spark, sf_dir):
    """A chunk table of the documents from which rows are missing and in which offsets are off."""
    rows = pools.in_address_order(_docs(spark, sf_dir).select("doc_id", F.octet_length(_bytes()).cast("long").alias("stored")), ["doc_id"]).withColumnRenamed("place", "idx")
    moved = with_offsets(rows).withColumn("offset", F.col("offset") + F.when(F.col("idx") % 89 == 7, 1).otherwise(0))
    return archive.validate_chunks(moved.where("idx % 97 <> 50"))


@query("""SELECT l_orderkey, l_linenumber, min(CASE l_returnflag WHEN 'A' THEN 'fast' WHEN 'N' THEN 'smart' ELSE 'sync' END) AS path FROM lineitem GROUP BY ALL""")
def accepted_paths(spark, sf_dir):
    """Frames that several paths accepted: the first path's stays."""
    lines = table(spark, sf_dir, "lineitem")
    of = lambda f: lines.where(F.col("l_returnflag") == f).select("l_orderkey", "l_linenumber").distinct()
    return pools.accepted_by({"fast": of("A"), "smart": of("N"), "sync": of("R")}, ["l_orderkey", "l_linenumber"])


@query("""SELECT o_custkey % 211 AS tag, count(DISTINCT o_custkey) AS n_archives FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1""")
def tag_collisions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 211).alias("tag"), F.col("o_custkey").alias("archive"), "o_orderstatus")
    pools_of = [orders.where(F.col("o_orderstatus") == s) for s in "FOP"]
    return pools.mixed(pools_of, "tag", "archive")[1]


@query("""SELECT source, count(*) AS n FROM (SELECT l_suppkey AS source FROM lineitem UNION ALL SELECT -1 FROM orders) GROUP BY 1""")
def contaminated_pool(spark, sf_dir):
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("read"))
    junk = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read"))
    return pools.contaminated(reads, junk).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 11 = 1 THEN 'EXTRA' ELSE 'CHANGED' END AS fault FROM documents WHERE doc_id % 11 < 3""")
def package_faults(spark, sf_dir):
    """A package's list against what is in it."""
    files = _docs(spark, sf_dir).select("doc_id", F.sha2(_bytes(), 256).alias("h"))
    found = files.where("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 11 == 2, F.lit("0")).otherwise(F.col("h")))
    return pools.set_differences(files.where("doc_id % 11 <> 1"), found, "doc_id", "h")


@query("SELECT l_suppkey, CAST(CAST(('0x' || substr(md5('7:' || l_orderkey), 1, 15)) AS BIGINT) % 2 AS INT) AS half, count(*) AS n FROM lineitem GROUP BY ALL")
def stable_halves(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return pools.halves(rows, ["l_orderkey"], 7).groupBy("l_suppkey", "half").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND length(text) >= 500")
def unplaced_reads(spark, sf_dir):
    return pools.unplaced(_docs(spark, sf_dir), F.col("doc_id") % 3 == 0, F.length("text"), 500).select("doc_id")


@query("""SELECT l_returnflag, CASE WHEN l_quantity - 25 NOT BETWEEN -20 AND 20 OR l_linenumber > 6 THEN 'window_out' WHEN l_linenumber > 3 THEN 'excluded' ELSE 'kept' END AS used, count(*) AS n FROM lineitem GROUP BY ALL""")
def read_inclusion(spark, sf_dir):
    rows = pools.inclusion(table(spark, sf_dir, "lineitem"), F.col("l_quantity") - 25, F.col("l_linenumber"), 10, (-20, 20), 0.6, 0.3)
    return rows.groupBy("l_returnflag", "used").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey AS id, 64 AS k, 16 AS m, 40 AS payload, CAST(floor(o_totalprice) AS BIGINT) * (o_custkey % 9) * 1000 AS size FROM orders),
x AS (SELECT id, CAST(ceil(size / 40.0) AS BIGINT) AS data_symbols, CAST(ceil(size / 2560.0) AS BIGINT) * 80 AS claimed FROM c)
SELECT id, data_symbols, claimed, 8 * 500000 + 1048576 AS "limit" FROM x WHERE data_symbols > 500000 AND claimed > 8 * 500000 + 1048576""")
def forged_claims(spark, sf_dir):
    size = F.floor("o_totalprice").cast("bigint") * (F.col("o_custkey") % 9) * 1000
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(64).alias("k"), F.lit(16).alias("m"), F.lit(40).alias("payload"), size.alias("size"))
    return pools.unsupported_claims(claims, F.lit(500_000)).select("id", "data_symbols", "claimed", "limit")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS place FROM lineitem")
def address_order(spark, sf_dir):
    """Rows numbered in the order of their addresses."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return pools.in_address_order(table(spark, sf_dir, "lineitem").select(*order), order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


@query(f"WITH {PAIRS_SQL} SELECT a, b, n_shared, row_number() OVER (ORDER BY n_shared DESC, a, b) - 1 AS place FROM c")
def pair_order(spark, sf_dir):
    return pools.ranked_pairs(candidate_pairs(spark, sf_dir))


@query(f"WITH {_STRANDS}, v AS (SELECT doc_id, pos, {_V} AS v FROM strands) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(v AS BIGINT) AS violations FROM v WHERE v > 0 ORDER BY doc_id, pos LIMIT 100")
def first_violations(spark, sf_dir):
    rows = pools.first_violations(screening.screen(_cut_strands(spark, sf_dir), RULES), ["doc_id", "pos"])
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("violations").cast("long").alias("violations"))


# --- findings ---------------------------------------------------------------------------------------------------------

_SECURITY = {
    "kind": "CASE event_id % 10 WHEN 0 THEN 'auth' WHEN 1 THEN 'integrity' WHEN 2 THEN 'config' ELSE 'request' END",
    "result": "CASE event_type WHEN 'error' THEN 'deny' WHEN 'signup' THEN 'error' WHEN 'click' THEN 'deny' ELSE 'allow' END",
    "code": "CASE event_id % 13 WHEN 0 THEN 'bad_signature' WHEN 1 THEN 'expired' WHEN 2 THEN 'policy' WHEN 3 THEN 'capability' WHEN 4 THEN 'malformed' WHEN 5 THEN 'integrity' WHEN 6 THEN 'replay' WHEN 7 THEN 'token_revoked' WHEN 8 THEN 'session_mismatch' WHEN 9 THEN 'bad_secret' WHEN 10 THEN 'key_mismatch' ELSE '' END",
    "session": "concat('s', user_id % 20)",
    "principal": "concat('p', user_id % 7)",
    "resource": "CASE WHEN event_id % 31 = 0 THEN 'deception:x' ELSE concat('r', event_id % 97) END",
}
_SECURE = "e AS (SELECT event_id, ts, " + ", ".join(f"{v} AS {k}" for k, v in _SECURITY.items()) + " FROM events)"
SCALE = 288


def _secure(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "ts", *[F.expr(v).alias(k) for k, v in _SECURITY.items()])


@query(f"""WITH {_SECURE} SELECT event_id, session, 'revoked_credential_use' AS rule, 'HIGH' AS severity FROM e WHERE code LIKE '%_revoked' UNION ALL SELECT event_id, session, 'replay', 'HIGH' FROM e WHERE code IN ('replay', 'stale_request')
UNION ALL SELECT event_id, session, 'token_misuse', 'HIGH' FROM e WHERE code = 'session_mismatch' UNION ALL SELECT event_id, session, 'integrity_monitor', 'CRITICAL' FROM e WHERE kind = 'integrity' AND result <> 'allow'
UNION ALL SELECT event_id, session, 'config_change', 'HIGH' FROM e WHERE kind = 'config' AND result <> 'allow' UNION ALL SELECT event_id, session, 'deception', 'CRITICAL' FROM e WHERE kind = 'request' AND resource LIKE 'deception:%'
UNION ALL SELECT event_id, session, 'privilege_escalation', 'HIGH' FROM e WHERE kind = 'request' AND result = 'deny' AND code = 'capability' UNION ALL SELECT event_id, session, 'unexpected_key_usage', 'HIGH' FROM e WHERE kind = 'request' AND code = 'key_mismatch'""")
def single_findings(spark, sf_dir):
    return security.single_findings(_secure(spark, sf_dir))


def _counting_sql() -> str:
    out = []
    for name, (condition, key, seconds, least, severity) in security.COUNTING.items():
        window = f"PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {seconds * SCALE} SECONDS PRECEDING AND CURRENT ROW"
        out.append(f"SELECT event_id, '{name}' AS rule, '{severity}' AS severity, n FROM (SELECT event_id, count(*) OVER ({window}) AS n FROM e WHERE {condition}) WHERE n >= {least}")
    return f"WITH {_SECURE} " + " UNION ALL ".join(out)


@query(_counting_sql())
def counting_findings(spark, sf_dir):
    """Windows widened to the log's density; before one finding a window silences the next (see once_per_window)."""
    return security.counting_findings(_secure(spark, sf_dir), scale=SCALE, suppress=False)


def _escalating_sql() -> str:
    out = []
    for name, (condition, seconds, least, low, high) in security.ESCALATING.items():
        window = f"PARTITION BY session ORDER BY ts RANGE BETWEEN INTERVAL {seconds * SCALE} SECONDS PRECEDING AND CURRENT ROW"
        out.append(f"SELECT event_id, '{name}' AS rule, CASE WHEN n >= {least} THEN '{high}' ELSE '{low}' END AS severity, n FROM (SELECT event_id, count(*) OVER ({window}) AS n FROM e WHERE {condition})")
    return f"WITH {_SECURE} " + " UNION ALL ".join(out)


@query(_escalating_sql())
def escalating_findings(spark, sf_dir):
    return security.escalating_findings(_secure(spark, sf_dir), scale=SCALE)


# --- tallies ----------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS a FROM conversations), q AS (SELECT *, substr(a, 1, 6) || substr(a, 8, 12) || 'Q' || substr(a, 20, 20) || '#' || substr(a, 41) AS b FROM p)
SELECT conv_id, turn, CAST(levenshtein(a, b) AS INT) AS distance FROM q""")
def aligned_turns(spark, sf_dir):
    """Turns against copies with a letter gone, one put in and one exchanged: the alignment has as many edits as the distance."""
    part = lambda i, n: F.substring("a", i, n)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "?")  # the SQL engine's distance counts bytes
    rows = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", plain.alias("a"))
    rows = rows.withColumn("b", F.concat(part(1, 6), part(8, 12), F.lit("Q"), part(20, 20), F.lit("#"), part(41, 1 << 30)))
    found = tally.aligned(rows, ["conv_id", "turn"], "a", "b", band=8)
    edits = F.aggregate(T.cigar_runs(F.col("cigar")), F.lit(0), lambda n, r: n + F.when(r["op"] == "=", 0).otherwise(r["n"]))
    return found.select("conv_id", "turn", F.when(edits == F.col("distance"), F.col("distance")).alias("distance"))


@query(f"""WITH e AS MATERIALIZED (SELECT lang, {_SEQ} AS seq FROM documents), k AS (SELECT lang, unnest(regexp_extract_all(seq, '...') || regexp_extract_all(substr(seq, 2), '...') || regexp_extract_all(substr(seq, 3), '...')) AS context FROM e)
SELECT lang, context, count(*) AS n FROM k GROUP BY ALL""")
def context_counts(spark, sf_dir):
    return tally.contexts(_encoded(spark, sf_dir), ["lang"])


@query("""WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_suppkey, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM s t WHERE t.l_suppkey = s.l_suppkey AND t.l_partkey = s.l_partkey + 1)) AS n_adjacent FROM s GROUP BY 1""")
def adjacent_sites(spark, sf_dir):
    sites = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return pools.adjacent_sites(sites, ["l_suppkey"], "l_partkey")


@query("""WITH t AS (SELECT l_suppkey AS ref, l_returnflag AS block, sum(l_linenumber) AS e FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey AS ref, sum(l_quantity) AS n FROM lineitem GROUP BY 1)
SELECT ref, block, CAST(e AS BIGINT) AS n_events, round(e / n, 9) AS rate FROM t JOIN s USING (ref)""")
def rate_estimates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_suppkey").alias("ref"), F.col("l_returnflag").alias("block"), F.col("l_linenumber").alias("cnt"))
    sites = lines.groupBy(F.col("l_suppkey").alias("ref")).agg(F.sum("l_quantity").alias("n_sites"))
    return tally.estimates(rows, sites, ["ref"]).select("ref", "block", "n_events", F.round("rate", 9).alias("rate"))


@query("""SELECT l_suppkey AS ref, count(*) AS n, round(avg(CAST(l_quantity AS BIGINT)), 9) AS mean, round(1 / avg(CAST(l_quantity AS BIGINT)), 9) AS geometric FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def run_length_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ref"), F.col("l_returnflag").alias("block"), F.col("l_quantity").cast("int").cast("string").alias("idx")).agg(F.count("*").alias("cnt"))
    return tally.run_lengths(rows, ["ref"], "R").withColumns({c: F.round(c, 9) for c in ("mean", "geometric")})


# --- votes ------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_suppkey AS grp, l_linenumber AS pos, [count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'N'), count(*) FILTER (l_returnflag = 'R')] AS n FROM lineitem GROUP BY ALL),
s AS (SELECT *, list_reverse_sort(n) AS r, list_sum(n) AS t FROM c)
SELECT grp, pos, ['A', 'N', 'R'][list_position(n, r[1])] AS called, CAST(t AS BIGINT) AS n_votes FROM s WHERE t >= 3 AND r[1] >= 0.5 * t AND r[1] - r[2] >= 2""")
def certain_calls(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("letter"))
    return consensus.certain_calls(rows, ["grp", "pos"], "letter", ("A", "N", "R"), 0.5)


_POSTERIOR = """o AS (SELECT l_orderkey AS grp, l_returnflag AS letter, least(0.75, greatest(1e-6, pow(10.0, -l_quantity / 10.0))) AS e FROM lineitem),
l AS (SELECT grp, x.letter, sum(CASE WHEN o.letter = x.letter THEN ln(1 - e) ELSE ln(e / 2) END) AS s FROM o, (VALUES ('A'), ('N'), ('R')) AS x(letter) GROUP BY ALL),
p AS (SELECT grp, letter, exp(s - max(s) OVER (PARTITION BY grp)) AS u FROM l), q AS (SELECT grp, letter, u / sum(u) OVER (PARTITION BY grp) AS p FROM p)"""


def _posterior(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("letter"), F.col("l_quantity").alias("quality"))
    return consensus.posterior(rows, ["grp"], "letter", "quality", ("A", "N", "R"))


@query(f"WITH {_POSTERIOR} SELECT grp, letter, round(p, 7) AS p FROM q")
def letter_posterior(spark, sf_dir):
    return _posterior(spark, sf_dir).select("grp", "letter", F.round("p", 7).alias("p"))


@query(f"WITH {_POSTERIOR} SELECT grp, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END), 6) AS bits FROM q GROUP BY grp")
def position_entropy(spark, sf_dir):
    return consensus.entropy(_posterior(spark, sf_dir), ["grp"]).withColumn("bits", F.round("bits", 6))


# --- experiments ------------------------------------------------------------------------------------------------------


@query("SELECT l_shipdate IS NULL AS no_date, l_returnflag || '.' || l_linestatus AS name, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def merged_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").isNull().alias("no_date"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("name"), F.col("l_linenumber").alias("n"))
    return experiments.counters(rows, ["no_date"], "name", "n")


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS f, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END), 0) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, round(CASE WHEN n = 0 THEN 0.0 ELSE f / n END, 9) AS finished, round(CASE WHEN n = f THEN 0.0 ELSE p / (n - f) END, 9) AS pending FROM c""")
def realised_rates(spark, sf_dir):
    status = F.col("o_orderstatus")
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    counts = joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(status == "F").alias("f"), F.count_if(status == "P").alias("p"))
    out = experiments.realised_rates(counts, {"finished": ("f", "n"), "pending": ("p", "n - f")})
    return out.select("c_custkey", F.round("finished", 9).alias("finished"), F.round("pending", 9).alias("pending"))


@query("SELECT n_reads, round(sum(w), 4) AS w FROM (SELECT l_orderkey, count(*) AS n_reads, sum(l_discount) AS w FROM lineitem GROUP BY 1) GROUP BY 1")
def weighted_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_reads"), F.sum("l_discount").alias("weight"))
    return experiments.weighted_histogram(rows, [], "n_reads", "weight").withColumn("w", F.round("w", 4))


@query("""SELECT l_orderkey, round(exp(sum(ln(1 - q))) * (1 + sum(q / (1 - q))), 9) AS p FROM (SELECT l_orderkey, l_discount / 3 + 0.0137 AS q FROM lineitem) GROUP BY 1""")
def row_failures(spark, sf_dir):
    """The probability that at most one of an order's lines fails: in closed form in SQL."""
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_discount") / 3 + 0.0137)
    return experiments.at_most_failed(rows, ["l_orderkey"], ["l_linenumber"], "q", 1).withColumn("p", F.round("p", 9))


@query("""SELECT o_custkey, bool_and(coalesce(x <= 300000, false)) AS ok, count(*) FILTER (coalesce(x <= 300000, false) = false) AS n_over FROM (SELECT o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders) GROUP BY 1""")
def load_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("x", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")))
    return experiments.load_gate(rows, ["o_custkey"], "x", 300_000)


@query("""WITH a AS (SELECT l_suppkey AS path, avg(l_quantity) AS value, avg(l_quantity) - 1 AS low, avg(l_quantity) + 1 AS high FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS path, avg(l_quantity) AS refit FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT path, round(value, 6) AS value, round(refit, 6) AS refit, refit BETWEEN low AND high AS inside FROM a JOIN b USING (path)""")
def fit_validation(spark, sf_dir):
    mean = lambda f: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("path")).agg(F.avg("l_quantity").alias("value"))
    fitted = mean("A").withColumns({"low": F.col("value") - 1, "high": F.col("value") + 1})
    return experiments.validated(fitted, mean("R"), ["path"]).withColumns({c: F.round(c, 6) for c in ("value", "refit")})


_CODES = [c for c, _, _, _ in taxonomy.rows()]


@query(f"""WITH codes(code, category, exit_code, retryable) AS (VALUES {', '.join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in taxonomy.rows())}),
r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 41 = 0 THEN 'NEVER_HEARD_OF' ELSE {_CODES}[CAST(o_orderkey % {len(_CODES)} AS INT) + 1] END AS code FROM orders)
SELECT o_orderkey, CASE WHEN r.code IS NULL THEN 'SUCCESS' ELSE coalesce(category, 'INTERNAL_ERROR') END AS category, CASE WHEN r.code IS NULL THEN 0 ELSE coalesce(exit_code, 70) END AS exit_code, coalesce(retryable, false) AS retryable FROM r LEFT JOIN codes USING (code)""")
def error_codes(spark, sf_dir):
    known = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("o_orderkey") % len(_CODES) + 1).cast("int"))
    code = F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("string")).when(F.col("o_orderkey") % 41 == 0, "NEVER_HEARD_OF").otherwise(known)
    return taxonomy.explained(table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")), "code").select("o_orderkey", "category", "exit_code", "retryable")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'superblock' WHEN 1 THEN 'archive' WHEN 2 THEN 'read_parsing' WHEN 3 THEN 'other:outer' ELSE CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_custkey % 4 > 0 THEN 'outer_ecc' ELSE 'archive' END END AS stage FROM orders""")
def terminal_stages(spark, sf_dir):
    kind = F.col("o_orderkey") % 6
    code = F.when(kind == 0, "NO_SUPERBLOCK").when(kind == 3, "BUDGET_EXCEEDED")
    stage = F.when(kind == 1, "integrity").when(kind == 2, "format").when(kind == 3, "outer")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED")
    return table(spark, sf_dir, "orders").select("o_orderkey", experiments.terminal_stage(status, code, stage, F.col("o_custkey") % 4).alias("stage"))


@query("""SELECT CASE WHEN l_linenumber = 1 THEN 'accepted' WHEN l_partkey % 5 = 0 AND l_quantity > 6 THEN 'drift_beyond_band' WHEN l_partkey % 5 = 0 THEN 'path_beyond_band' WHEN l_suppkey % 30 > 16 THEN 'erasures_exceed_parity'
WHEN l_returnflag <> 'A' THEN 'inner_ecc' WHEN l_linestatus <> 'F' THEN 'crc' ELSE 'address' END AS fate, count(*) AS n FROM lineitem GROUP BY 1""")
def read_fates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") == 1).alias("accepted"), (F.col("l_partkey") % 5 != 0).alias("aligned"), F.col("l_quantity").alias("drift"), (F.col("l_suppkey") % 30).alias("erased_bytes"),
        (F.col("l_returnflag") == "A").alias("rs_ok"), (F.col("l_linestatus") == "F").alias("crc_ok"),
    )
    return experiments.first_failing_stage(rows, 6, 16).groupBy("fate").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority AS parameter, o_orderstatus AS value, count(*) AS n, count(*) FILTER (o_custkey % 3 = 0) AS n_success, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def sweep_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("parameter"), F.col("o_orderstatus").alias("value"), (F.col("o_custkey") % 3 == 0).alias("ok"), "o_totalprice")
    return experiments.summaries(rows, "parameter", "value", "ok", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("""SELECT event_type AS name, NULL AS class, NULL AS backend, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY 1 UNION ALL
SELECT event_type, CAST(user_id % 4 AS VARCHAR), CAST(event_id % 3 AS VARCHAR), round(sum(value), 4), max(value) FROM events GROUP BY 1, 2, 3""")
def metric_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 4).cast("string").alias("class"), (F.col("event_id") % 3).cast("string").alias("backend"), "value")
    return experiments.rolled_up(rows, "name", ["class", "backend"], "value").withColumn("total", F.round("total", 4))


@query("""SELECT conv_id, role, count(*) AS n, arg_min(md5(text), turn) AS first, arg_max(md5(text), turn) AS last FROM conversations GROUP BY ALL""")
def decision_log(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("action"))
    return experiments.provenance(rows, "conv_id", ["turn"], "role", "action")


# --- recovery ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id % 10 <> 9 OR strlen(coalesce(text, '')) <= 288 AS verified FROM documents")
def stripe_recovery(spark, sf_dir):
    """Documents in stripes of four rows; symbols and whole rows are lost, of every tenth document more rows than the columns can bear."""
    g = stripes.Geometry(6, 2, 4, 2, 24)
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("file"), _bytes().alias("data"))
    sizes = docs.select("file", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"))
    sent = stripes.encode(stripes.cut_into_symbols(docs, "file", F.col("data"), g), g)
    some = (F.col("line") * 7 + F.col("symbol") * 3 + F.col("file")) % 5 == 0
    row = ((F.col("file") + F.col("stripe")) % 3 == 0) & (F.col("line") == 1)
    rows = (F.col("file") % 10 == 9) & (F.col("line") < 3)
    found = stripes.recover(sent.where(~(some & (F.col("line") < 4)) & ~row & ~rows), sizes, g)
    whole = found.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stripe", "line", "symbol", F.hex("payload").alias("h")))), lambda x: x["h"]), "").alias("h"))
    out = sizes.join(whole, "file", "left").withColumn("data", F.unhex(F.substring(F.coalesce("h", F.lit("")), F.lit(1), (2 * F.col("size")).cast("int"))))
    return out.select(F.col("file").alias("doc_id"), "sha256", F.coalesce(F.sha2("data", 256) == F.col("sha256"), F.lit(False)).alias("verified"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id % 50 <> 2 OR coalesce(text, '') = '' AS verified FROM documents WHERE doc_id % 50 <> 1""")
def pool_recovery(spark, sf_dir):
    """All documents in one pool of shuffled reads, decoded from the reads alone; of some the descriptions are lost, of some the data."""
    from ..kernels.channel import Channel
    from . import codec

    docs = _docs(spark, sf_dir)
    strands = codec.encode(docs, "doc_id", _bytes(), described=True)
    kept = strands.where(~((F.col("file") % 50 == 1) & (F.col("grp") < 0)) & ~((F.col("file") % 50 == 2) & (F.col("grp") >= 0) & ((F.col("symbol") < 40) | (F.col("symbol") >= 64))))
    reads = codec.read(kept, Channel(seed=11, coverage=4.0, model="fixed", substitution=0.004, insertion=0.0001, deletion=0.0001, reverse=0.5))
    _, verdicts = codec.decode_pool(reads.select("seq", "qual"))
    names = docs.select("doc_id", (F.col("doc_id") % 65_536).cast("int").alias("tag"))
    return verdicts.join(names, "tag").select("doc_id", "sha256", "verified")
