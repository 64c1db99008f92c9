"""Second looks at reads that no frame came out of: soft decisions, then consensus of clusters (A6, A8, D12, D13, D15, M25, T11 rows).

The rounds go from cheap to dear; each works only on what the rounds before left
open, and what it finds only fills addresses that nobody had (fill-only). Every
frame found this way passed the inner code and its CRC like any other.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import alignment, frames
from ..operators import clustering, consensus
from ..operators.common import cut
from . import codec

#: Members of a cluster that vote (the first by id), rounds of voting, band of their alignments.
MEMBERS, ROUNDS, BAND = 64, 2, 16
FOUND = "read bigint, ok boolean, kind int, tag int, grp bigint, symbol int, payload binary"


def soft(reads: DataFrame, profile: str = "v4-balanced") -> DataFrame:
    """read, ok, kind, tag, grp, symbol, payload of reads (read, seq, qual) of the strands' length.

    The least reliable bytes are declared erased, two more at a time up to what the inner code can bear, until a
    frame comes out; both ways round.
    """
    layout = frames.PROFILES[profile][0]
    complement = np.array([3, 2, 1, 0, 4], np.uint8)

    def run(batches):
        for whole in batches:
            for b in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                ids, seqs, quals = (b.column(i).to_pylist() for i in range(3))
                at = [i for i, (s, q) in enumerate(zip(seqs, quals, strict=True)) if s is not None and q is not None and len(s) == len(q) == layout.strand_nt]
                out: list[tuple] = []
                if at:
                    codes, quality = np.stack([frames.codes(seqs[i]) for i in at]), np.stack([np.frombuffer(quals[i], np.uint8) for i in at])
                    open_rows = np.arange(len(at))
                    for turn in (False, True):
                        if not len(open_rows):
                            break
                        c, q = codes[open_rows], quality[open_rows]
                        p = frames.softly(layout, complement[c[:, ::-1]] if turn else c, q[:, ::-1] if turn else q)
                        for i in np.flatnonzero(p.ok):
                            out.append((ids[at[open_rows[i]]], True, int(p.kind[i]), int(p.tag[i]), int(p.group[i]), int(p.symbol[i]), p.payload[i].tobytes()))
                        open_rows = open_rows[~p.ok]
                kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    return reads.select("read", "seq", "qual").mapInArrow(run, FOUND)


def medoid(seqs: list[str]) -> int:
    """The read with the least distance to the first dozen of the others; the first of equals."""
    some = seqs[:12]
    best, least = 0, None
    for i, s in enumerate(some):
        total = sum(found[0] if (found := alignment.align(s, t, BAND)) else len(s) for t in some)
        if least is None or total < least:
            best, least = i, total
    return best


def voted(centre: str, seqs: list[str]) -> str:
    """The letters that most of the reads have at each position of ``centre``; ties keep the centre's.

    A position is left out if most reads lack it, and letters are put in after it where more than half of all reads
    have the same ones there.
    """
    here = [Counter() for _ in centre]
    after = [Counter() for _ in range(len(centre) + 1)]
    n = 0
    for s in seqs:
        found = alignment.align(centre, s, BAND)
        if found is None:
            continue
        n += 1
        i = j = 0
        for op, k in alignment.leftmost(centre, s, found[1]):
            if op == alignment.EXTRA:
                after[i][s[j : j + k]] += 1
            for d in range(k if op != alignment.EXTRA else 0):
                here[i + d]["" if op == alignment.GONE else s[j + d]] += 1
            i, j = i + k * (op != alignment.EXTRA), j + k * (op != alignment.GONE)
    put = lambda c: max(c.items(), key=lambda x: (x[1], x[0]))[0] if c and 2 * max(c.values()) > n else ""
    out = [put(after[0])]
    for i, c in enumerate(here):
        best = max(c.values(), default=0)
        out += [centre[i] if c[centre[i]] == best else min(x for x, v in c.items() if v == best), put(after[i + 1])]
    return "".join(out)


def clusters(reads: DataFrame, share: float = 0.3) -> DataFrame:
    """read, seq, root: reads (read, seq) that share sketches and are alike, turned as the cluster's first read lies."""
    held = cut(reads.select("read", "seq"))
    sketches = cut(clustering.oriented_sketch(held, "read", F.col("seq")))
    pairs = clustering.verified(clustering.oriented_candidates(sketches, "read"), held, "read", "seq", share)
    labels = clustering.oriented_components(cut(pairs.select("a", "b", "rel")))
    from ..functions.sequences import reverse_complement

    turned = F.when(F.col("flipped"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return labels.withColumnRenamed("node", "read").join(held, "read").select("read", turned.alias("seq"), "root")


def consensus_reads(clustered: DataFrame, least: int = 2, members: int = MEMBERS) -> DataFrame:
    """root, n, seq: what each cluster of at least ``least`` reads has in common."""
    capped = consensus.capped(clustered, ["root"], ["read"], members)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("read").to_numpy())
        seqs = [table.column("seq")[int(i)].as_py() for i in order]
        root = table.column("root")[0].as_py()
        if len(seqs) < least:
            return pa.table({"root": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "seq": pa.array([], pa.string())})
        centre = seqs[medoid(seqs)]
        for _ in range(ROUNDS):
            centre = voted(centre, seqs)
        return pa.table({"root": pa.array([root], pa.int64()), "n": pa.array([len(seqs)], pa.int32()), "seq": pa.array([centre])})

    return capped.select("root", "read", "seq").groupBy("root").applyInArrow(run, "root bigint, n int, seq string")


def rounds(reads: DataFrame, scanned: DataFrame, profile: str = "v4-balanced", shortest: int = 100) -> tuple[DataFrame, DataFrame]:
    """(frames: kind, tag, grp, symbol, payload, round; log: round, n_reads, n_frames).

    ``reads``: read, seq, qual; ``scanned``: as ``codec.scan`` gives. Frames of the second looks only fill addresses.
    """
    address = ["kind", "tag", "grp", "symbol"]
    of = lambda df, name: df.select(*address, "payload", F.lit(name).alias("round"))
    resolved = lambda df: consensus.majority(df.where("ok"), address, "payload").select(*address, "payload")
    found = cut(of(resolved(scanned), "scan"))
    log = [("scan", scanned.count(), found.count())]
    left = reads.join(scanned.where("ok").select("read"), "read", "left_anti")

    again = cut(soft(left, profile))
    more = cut(consensus.fill_only(found, of(resolved(again), "soft"), address))
    log.append(("soft", left.count(), more.count() - found.count()))
    found, left = more, left.join(again.select("read"), "read", "left_anti").where(F.length("seq") >= shortest)

    common = cut(consensus_reads(clusters(left)))
    looked = codec.scan(common.select(F.lit(0).cast("bigint").alias("file"), F.col("root").alias("read"), "seq", F.lit(None).cast("binary").alias("qual")), profile)
    more = cut(consensus.fill_only(found, of(resolved(looked), "cluster"), address))
    log.append(("cluster", left.count(), more.count() - found.count()))
    return more, reads.sparkSession.createDataFrame(log, "round string, n_reads bigint, n_frames bigint")
