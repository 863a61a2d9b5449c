"""Near-duplicate components by an exact Jaccard self-join on word shingles.

Multiple global orders: under any one order of all tokens, two sets as similar as asked
share a token in their prefixes. Candidates must share one in the order of rarity, pass its length and
position bounds, and then share one in each further order before they are verified.
Documents of equal sets are one class. Links to the leader of each prefix token's group
are verified first; afterwards only documents of different components need be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.components import connected_components
from lexiframe.llm.keys import NO_ID, present
from lexiframe.llm.words import BASES, LOWER_ASCII, Powers, Rolling, WordHashes, mix, release_memory, signed
from lexiframe.session import materialize, partition_by

WORDS = 4
PERCENT = 85
# The order of rarity knows so many frequent tokens; all others count as rare. Any order gives the same links.
FREQUENT = 1 << 15
# Further orders, as seeds of a scrambling of the token hashes.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344)
CELLS = 128
# A fine sketch has about a cell for every two tokens.
FINE_CELLS = (128, 8192)
# A token's documents are compared in blocks of about so many.
BLOCK = 2048
# The filter on ids that need verification has 2**BITS bits.
BITS = 23


def shingles(text: str | None, hashes: WordHashes, powers: Powers, k: int) -> np.ndarray:
    """The distinct hashes of a text's ``k``-word shingles in ascending order."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    rolling = Rolling(hashes.of(words), powers)
    if len(words) < k:
        return rolling.between(np.array([0]), np.array([len(words)]))
    return np.unique(rolling.runs(k))


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` of which a similar set has one at least."""
    return n + (-percent * n) // 100 + 1


def _cells(own: np.ndarray, n_cells: int) -> bytes:
    """Tokens per cell, up to 255, of a set of hashes; the cells of two sets differ by no more than the sets do."""
    cells = np.bincount((own & np.uint64(n_cells - 1)).astype(np.int64), minlength=n_cells)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _cells_apart(a: bytes, b: bytes) -> int:
    """The least symmetric difference by two sketches; the finer one is folded to the other's cells."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    cells = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, cells).sum(axis=0) - y.reshape(-1, cells).sum(axis=0)).sum())


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles in ascending order, and their counts: at most FREQUENT rows.

    A task reports the shingles that stand in many texts of one of its batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, powers = WordHashes(), Powers(BASES[0])
        for batch in batches:
            found = [shingles(t, hashes, powers, k) for t in batch["text"]]
            values, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            often = n >= max(4, len(batch) // 1000)
            yield pd.DataFrame({"token": signed(values[often]), "n": n[often]})
        hashes.clear()
        release_memory()

    counts = docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def _features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(node, n, class_a, class_b, prefix, sketch, fine)`` of every row.

    The class is a 128-bit hash of the set; ``sketch`` has CELLS cells, ``fine`` as many as the set is large.
    """
    tokens, counts = _frequent(docs, k)
    frequent = docs.sparkSession.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, powers = WordHashes(), Powers(BASES[0])
        tokens, counts = frequent.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                own = shingles(text, hashes, powers, k)
                n = len(own)
                at = np.searchsorted(tokens, own)
                often = np.zeros(n, bool)
                if len(tokens):
                    often = tokens[np.minimum(at, len(tokens) - 1)] == own
                late = own[often]
                late = late[np.argsort(counts[at[often]], kind="stable")] if len(late) else late
                prefix = np.concatenate([own[~often], late])[: prefix_size(n, percent) if n else 0]
                fine = min(max(1 << max(n - 1, 1).bit_length() - 1, FINE_CELLS[0]), FINE_CELLS[1])
                a, b = mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(BASES[1])).sum(dtype=np.uint64)
                rows.append((n, *np.array([a, b], np.uint64).view(np.int64).tolist(), signed(prefix), _cells(own, CELLS), _cells(own, fine)))
            out = pd.DataFrame(rows, columns=["n", "class_a", "class_b", "prefix", "sketch", "fine"])
            out.insert(0, "node", batch["node"].to_numpy())
            yield out
        hashes.clear()
        release_memory()

    schema = "node long, n int, class_a long, class_b long, prefix array<long>, sketch binary, fine binary"
    return docs.mapInPandas(run, schema)


def _most_apart(n: Column, m: Column, percent: int) -> Column:
    """The largest symmetric difference of similar sets of ``n`` and ``m`` tokens."""
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return n + m - 2 * least


def _close(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Length and position bounds: sets of such sizes whose first common token stands at i and j."""
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (i + j <= _most_apart(n, m, percent))


def _sketch_filter(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that fine sketches do not rule out."""

    @F.pandas_udf("long")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_cells_apart(x, y) for x, y in zip(a, b)], dtype="int64")

    one = sizes.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("fine").alias("_s"))
    two = sizes.select(F.col("node").alias("b"), F.col("n").alias("_m"), F.col("fine").alias("_t"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.where(apart("_s", "_t") <= _most_apart(F.col("_n"), F.col("_m"), percent)).select("a", "b").distinct()


def _rows_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these nodes.

    A bitmap of hashed ids, of at most 2**(BITS - 6) rows, is broadcast and keeps most other texts
    from being shuffled; the join that follows is exact.
    """
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - BITS)
    bits = nodes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_word"))
    bits = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits"))
    at = docs.withColumn("_p", place).withColumn("_word", F.shiftright("_p", 6))
    maybe = at.join(F.broadcast(bits), "_word").where(F.expr("(shiftright(_bits, cast(_p % 64 as int)) & 1) = 1"))
    return maybe.select("node", "text").join(nodes, "node", "left_semi")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that share a prefix token in every further order and are similar."""
    pairs = materialize(pairs, "pairs")
    nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, powers = WordHashes(), Powers(BASES[0])
        for batch in batches:
            sets = [shingles(t, hashes, powers, k) for t in batch["text"]]
            out = {"node": batch["node"], "tokens": [signed(s) for s in sets]}
            for i, seed in enumerate(ORDERS):
                out[f"prefix_{i}"] = [
                    signed(s[np.argsort(mix(s ^ np.uint64(seed)))[: prefix_size(len(s), percent)]]) for s in sets
                ]
            yield pd.DataFrame(out)
        hashes.clear()
        release_memory()

    schema = "node long, tokens array<long>, " + ", ".join(f"prefix_{i} array<long>" for i in range(len(ORDERS)))
    sets = materialize(_rows_of(docs, nodes).mapInPandas(run, schema), "sets")
    one, two = sets.alias("x"), sets.alias("y")
    joined = pairs.join(one, F.col("a") == F.col("x.node")).join(two, F.col("b") == F.col("y.node"))
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    alike = F.lit(100) * shared >= F.lit(percent) * (F.size("x.tokens") + F.size("y.tokens") - shared)
    for i in range(len(ORDERS)):
        joined = joined.where(F.arrays_overlap(f"x.prefix_{i}", f"y.prefix_{i}"))
    return materialize(joined.where(alike).select("a", "b").distinct(), "links")


def _complete_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut so that no group of equal keys is parted."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy() if len(batch) else np.zeros(0, bool)
        cut = len(batch) - int(last.sum())
        rest = batch.iloc[cut:]
        if cut:
            yield batch.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def _pairs_of_unit(unit: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Candidate pairs of one unit: of one block with itself, or of two blocks of a token's documents."""
    n, pos, comp, node, block = unit["n"], unit["pos"], unit["component"], unit["node"], unit["block"]
    both = block.min() != block.max()
    mine = unit["u1"][0] != unit["u2"][0]
    found = []
    total = len(n)
    index = np.arange(total)
    for a in range(0, total, 256):
        i = index[a : a + 256, None]
        ok = (comp[i] != comp[None, :]) & (i < index[None, :])
        if mine:
            if not both:
                break
            ok &= block[i] != block[None, :]
        if not ok.any():
            continue
        small, large = np.minimum(n[i], n), np.maximum(n[i], n)
        least = -(-percent * (small + large) // (100 + percent))
        apart = small + large - 2 * least
        ok &= (100 * small >= percent * large) & (pos[i] + pos <= apart)
        x, y = np.nonzero(ok)
        for c in range(0, len(x), 65536):
            p, q = x[c : c + 65536] + a, y[c : c + 65536]
            cells = np.abs(unit["sketch"][p].astype(np.int16) - unit["sketch"][q]).sum(axis=1)
            keep = cells <= apart[p - a, q]
            found.append(np.stack([node[p[keep]], node[q[keep]]], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _between_components(shared: DataFrame, sizes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``(a, b)`` of different components that share a prefix token.

    Tokens whose documents are all of one component give nothing. The documents of a token are dealt
    to blocks of bounded size and blocks are compared two at a time, so that no task gets a whole group.
    """
    rows = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = materialize(rows.select("token", "node", "n", "pos", "component"), "shared")
    one = F.struct("component", "node", "n", "pos")
    mixed = rows.groupBy("token").agg(F.min(one).alias("_a"), F.max(one).alias("_b"), F.count(F.lit(1)).alias("_count"))
    mixed = materialize(mixed.where(F.col("_a.component") < F.col("_b.component")), "mixed")
    # A token of two documents is a pair as it is.
    close = _close(F.col("_a.n"), F.col("_b.n"), F.col("_a.pos"), F.col("_b.pos"), percent)
    two = mixed.where((F.col("_count") == 2) & close)
    two = two.select(F.least("_a.node", "_b.node").alias("a"), F.greatest("_a.node", "_b.node").alias("b"))
    mixed = mixed.where(F.col("_count") > 2).select("token", F.ceil(F.col("_count") / BLOCK).cast("int").alias("_blocks"))
    dealt = rows.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    units = (
        dealt.withColumn("_other", other)
        .withColumn("u1", F.least("block", "_other"))
        .withColumn("u2", F.greatest("block", "_other"))
        .join(sizes.select("node", "sketch"), "node")
        .select("token", "u1", "u2", "node", "n", "pos", "component", "block", "sketch")
    )
    keys = ["token", "u1", "u2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _complete_groups(batches, keys):
            columns = {c: batch[c].to_numpy() for c in batch.columns if c != "sketch"}
            columns["n"], columns["pos"] = columns["n"].astype(np.int64), columns["pos"].astype(np.int64)
            columns["sketch"] = np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(-1, CELLS)
            change = np.zeros(len(batch), bool)
            change[0] = True
            for key in keys:
                change[1:] |= columns[key][1:] != columns[key][:-1]
            edges = [*np.flatnonzero(change), len(batch)]
            found = [
                _pairs_of_unit({c: v[s:e] for c, v in columns.items()}, percent)
                for s, e in zip(edges[:-1], edges[1:])
                if e - s > 1
            ]
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            if len(pairs):
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    sorted_units = partition_by(units, *keys).sortWithinPartitions(*keys)
    return sorted_units.mapInPandas(run, "a long, b long").union(two).distinct()


def similar_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs(doc_id, text)``.

    A set holds the distinct ``k``-word shingles of the text with A-Z in lower case (fewer
    words: the whole sequence as one). Two documents link when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest doc_id reachable. A null text, or one without
    words, has the empty set and links with nothing. Rows that share a doc_id are one document, linked with
    all that any of them links with; so are rows with a null doc_id, whose component is the smallest other id
    they reach, or null. Other columns are not read. No rows give no rows.
    """
    texts = docs.select(present("doc_id").alias("node"), "text")
    features = materialize(_features(texts, k, percent), "features")
    filled = features.where(F.col("n") > 0)
    reps = materialize(
        filled.groupBy("class_a", "class_b", "n").agg(
            F.min("node").alias("node"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"),
            F.first("fine").alias("fine"),
        ),
        "classes",
    )
    sizes = reps.select("node", "n", "sketch", "fine")
    tokens = reps.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_count")).where(F.col("_count") > 1).select("token")
    shared = materialize(tokens.join(several, "token"), "prefixes")
    leaders = shared.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("leader"))
    # First the links to leaders: the document that has the token earliest in its order.
    close = _close(F.col("n"), F.col("leader.n"), F.col("pos"), F.col("leader.pos"), percent)
    stars = shared.join(leaders, "token").where((F.col("node") != F.col("leader.node")) & close)
    stars = stars.select(F.col("node").alias("a"), F.col("leader.node").alias("b")).distinct()
    links = _verify(_sketch_filter(stars, sizes, percent), texts, k, percent)
    # A doc_id in several classes is one document.
    same = features.join(reps.select("class_a", "class_b", "n", F.col("node").alias("rep")), ["class_a", "class_b", "n"])
    labels = connected_components(links)
    # Then what is left: pairs of different components.
    between = _sketch_filter(_between_components(shared, sizes, labels, percent), sizes, percent)
    more = _verify(between, texts, k, percent)
    members = materialize(same.select("node", "rep").distinct(), "members")
    joint = members.where(F.col("node") != F.col("rep")).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    several = members.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("node")
    joint = joint.join(several, F.col("a") == F.col("node"), "left_semi")
    labels = connected_components(links.union(more).union(joint))
    own = members.groupBy("node").agg(F.min("rep").alias("rep"))
    of_node = (
        own.join(labels, own.rep == labels.node, "left")
        .select(own.node, F.coalesce("component", "rep").alias("component"))
        .withColumn("component", F.least("component", "node"))
    )
    rows = features.select("node", "n").join(of_node, "node", "left")
    real = F.when(F.col("node") != NO_ID, F.col("node"))
    component = F.coalesce("component", "node")
    return rows.select(
        real.alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(component != NO_ID, component).alias("component_id"),
    )
