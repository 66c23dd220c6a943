"""Nearest name by edit distance, found through shared parts of the names.

The rule: a name of ``L`` characters is linked to the roster name at the least
Levenshtein distance ``d``, the earliest one on ties, if ``d`` is at most
``t = accepted_edits(L)``.

Names are compared only if they share a part. A name is cut in
``p = t // 2 + 1`` parts; ``t`` edits cannot put two edits in every part, so one
part survives with at most one edit. Moreover, with edits counted from the left,
there is a first part ``k`` (from 1) up to which at most ``2k - 1`` edits have
been spent, and at least ``2(k - 1)`` of them lie before it. That part starts in
the other name at most ``2k - 1`` places away, and what follows it must fit in
the edits that are left. A part and a stretch of text are within one edit if
they are equal after dropping one character from one of them or, at the same
place, from both. So candidates come from an equi-join on (length, part, dropped
place, remaining text), and a pair is dropped by its character counts, or else
by its distance, inside the join.

Distances are tried in steps: equal names first, then up to 1 edit, up to 3, and
at last up to the name's own limit, each time only for the names still open. A
name found within a step needs no wider step, as all roster names within the
step's distance were candidates.

Frequent parts (a common surname) would pair far too many names. Names that hold
one are cut again in ``p + s`` parts: at least ``s + 1`` of these survive with at
most one edit, so the ``s`` most frequent parts of each name can be left out
without losing a pair. Parts that are frequent even then are joined in blocks, so
that no task gets a whole group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import LEAST_EDITS, SHORTEST_NAME, accepted_edits, known, search_name
from .joins import lookup_join
from .lookup import lookup
from .sizing import broadcast_limit, fits_broadcast, measured

# Characters counted one by one in a name's signature; all others count together.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "
# Bits per character: counts above this are taken as equal.
COUNT_BITS = 3
ONES = ", ".join(f"{2**n - 1}L" for n in range(COUNT_BITS + 1))
PER_LONG = 63 // COUNT_BITS

# A part with more candidate pairs than this is frequent.
PAIRS_PER_TASK = 250_000
# Up to so many pairs in all, no part is called frequent.
FEW_PAIRS = 5_000_000
# Bytes of a key beside its two texts.
KEY_OVERHEAD = 64
# Parts that a name with frequent parts gets on top, and their least length.
MOST_SPARE_PARTS = 3
LEAST_PART = 4
# Largest distance of each step; None is the limit of the name itself.
STEPS = (1, LEAST_EDITS, None)


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Names evenly over all shuffle partitions: each becomes many keys."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def _signatures(prefix: str, text: str) -> dict[str, Column]:
    """Two longs with as many ones per character as the text holds, up to three.

    An edit changes at most one count up and one down, so two texts within ``t``
    edits have at most ``t`` ones that the other lacks, on either side.
    """
    counts = [f"length({text}) - length(translate({text}, '{c}', ''))" for c in COUNTED]
    counts.append(f"length(translate({text}, '{COUNTED}', ''))")
    bits = [
        f"shiftleft(element_at(array({ONES}), least({n}, {COUNT_BITS}) + 1), {i % PER_LONG * COUNT_BITS})"
        for i, n in enumerate(counts)
    ]
    return {
        f"{prefix}_low": F.expr(" | ".join(bits[:PER_LONG])),
        f"{prefix}_high": F.expr(" | ".join(bits[PER_LONG:])),
    }


def _near_signatures(a: str, b: str) -> Column:
    def lacking(x: str, y: str) -> Column:
        return F.bit_count(
            F.col(f"{x}_low").bitwiseAND(F.bitwise_not(f"{y}_low"))
        ) + F.bit_count(F.col(f"{x}_high").bitwiseAND(F.bitwise_not(f"{y}_high")))

    return (lacking(a, b) <= F.col("_t")) & (lacking(b, a) <= F.col("_t"))


def _limit(length: Column, cap: int | None) -> Column:
    own = accepted_edits(length)
    return own if cap is None else F.least(own, F.lit(cap))


def _without(text: Column, place: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), place - 1), F.substring(text, place + 1, F.length(text)))


def _code(length: Column, part: Column, place: Column) -> Column:
    """Length, part and dropped place in one number (places start at -1)."""
    return (
        F.shiftleft(length.cast("long"), 42)
        .bitwiseOR(F.shiftleft(part.cast("long"), 21))
        .bitwiseOR((place + 1).cast("long"))
    )


def _parts(spare: int) -> Column:
    return (F.col("_t") / 2).cast("int") + 1 + spare


def _exploded_parts(df: DataFrame, spare: int) -> DataFrame:
    """Parts ``_k`` of a text of ``_len``: ``_start`` and ``_size``, later parts longer."""
    parts = _parts(spare)
    base = (F.col("_len") / parts).cast("int")
    shorter = parts - F.col("_len") % parts
    before = F.col("_k") - 1
    return df.withColumn("_k", F.explode(F.sequence(F.lit(1), parts))).withColumns(
        {
            "_start": before * base + F.greatest(F.lit(0), before - shorter),
            "_size": base + (F.col("_k") > shorter).cast("int"),
        }
    )


def _query_keys(queries: DataFrame, cap: int | None, spare: int) -> DataFrame:
    """Keys of the parts of every query."""
    length = F.length("consulta")
    sized = queries.withColumns({"_len": length, "_t": _limit(length, cap)})
    part = F.substring("consulta", F.col("_start") + 1, F.col("_size"))
    # Place 0 is the whole part, against a longer stretch. A part without its
    # character x stands against an equally long stretch without its character
    # x, and (place -1) against a shorter stretch as it is.
    return (
        _exploded_parts(sized, spare)
        .withColumn("_part", part)
        .withColumn("_v", F.explode(F.sequence(-F.col("_size"), F.col("_size"))))
        .withColumn(
            "_text",
            F.when(F.col("_v") == 0, F.col("_part")).otherwise(
                _without(F.col("_part"), F.abs("_v"))
            ),
        )
        .withColumn(
            "_code", _code(F.col("_len"), F.col("_k"), F.greatest(F.col("_v"), F.lit(-1)))
        )
        .drop("_part", "_v")
    )


def _roster_keys(
    names: DataFrame, cap: int | None, lengths: list[int], spare: int
) -> DataFrame:
    """Keys of the stretches of a roster name that may be a part of a query."""
    size = F.length("nombre")
    # |L - size| <= max(3, L / 4) bounds L on both sides; the last filter is exact.
    low = F.least(size - 3, (size * 4 / 5).cast("int") - 1)
    high = F.greatest(size + 3, (size * 4 / 3).cast("int") + 1)
    if cap is not None:
        low, high = F.greatest(low, size - cap), F.least(high, size + cap)
    asked = F.array(*(F.lit(n) for n in lengths))
    sized = (
        names.withColumn("_len", F.explode(F.filter(asked, lambda n: n.between(low, high))))
        .withColumn("_t", _limit(F.col("_len"), cap))
        .filter(F.abs(size - F.col("_len")) <= F.col("_t"))
    )
    # Place of the stretch against the part, and its length against the part's.
    spent = F.lit(0) if spare else 2 * (F.col("_k") - 1)
    reach = F.col("_t") if spare else F.least(spent + 1, F.col("_t"))
    shifts = F.when(F.col("_k") == 1, F.lit(0)).otherwise(reach)
    moves = F.sequence(F.lit(0), (2 * shifts + 1) * 3 - 1)
    shift, growth = F.col("_shift"), F.col("_growth")
    after = size - F.col("_len") - shift - growth
    from_, width = F.col("_start") + shift, F.col("_size") + growth
    possible = (
        (F.abs(after) <= F.col("_t") - F.greatest(F.abs(shift), spent) - F.abs(growth))
        & ((F.col("_k") < _parts(spare)) | (after == 0))
        & (from_ >= 0)
        & (from_ + width <= size)
    )
    if not spare:
        possible = possible & (F.abs(shift) <= spent + 1 - F.abs(growth))
    stretches = (
        _exploded_parts(sized, spare)
        .withColumn("_w", F.explode(moves))
        .withColumns(
            {"_shift": (F.col("_w") / 3).cast("int") - shifts, "_growth": F.col("_w") % 3 - 1}
        )
        .filter(possible)
        .withColumn("_stretch", F.substring("nombre", from_ + 1, width))
    )
    places = F.when(growth < 0, F.lit(1)).otherwise(width)
    place = (
        F.when(growth < 0, F.lit(-1))
        .when(growth > 0, F.lit(0))
        .otherwise(F.col("_x"))
    )
    return (
        stretches.withColumn("_x", F.explode(F.sequence(F.lit(1), places)))
        .withColumn(
            "_text",
            F.when(growth < 0, F.col("_stretch")).otherwise(
                _without(F.col("_stretch"), F.col("_x"))
            ),
        )
        .withColumn("_code", _code(F.col("_len"), F.col("_k"), place))
        .drop("_w", "_shift", "_growth", "_stretch", "_x")
    )


KEY = ["_code", "_text"]


def _frequent(
    queries: DataFrame, names: DataFrame, n_names: int, pairs: int
) -> DataFrame | None:
    """Hash, query count and name count of every key with too many pairs, or None."""
    key = F.xxhash64(*KEY).alias("_hash")
    # Names are counted only for keys that enough queries ask for.
    asked = stored(
        queries.groupBy(key)
        .agg(F.count("*").alias("_nq"))
        .filter(F.col("_nq") * n_names > pairs)
    )
    if asked.isEmpty():
        return None
    told = names.select(key)
    if fits_broadcast(asked):
        told = told.join(F.broadcast(asked.select("_hash")), "_hash")
    # Names are counted before the join, so that a heavy key does not cross it.
    counted = told.groupBy("_hash").agg(F.count("*").alias("_nr"))
    frequent = stored(
        counted.join(asked.hint("merge"), "_hash").filter(F.col("_nq") * F.col("_nr") > pairs)
    )
    return None if frequent.isEmpty() else frequent


def _without_heaviest(queries: DataFrame, frequent: DataFrame, spare: int) -> DataFrame:
    """Keys of all parts but the ``spare`` most frequent ones of each query."""
    heavy = (
        queries.join(measured(frequent), "_hash")
        .groupBy("consulta", "_k")
        .agg(F.max("_nr").alias("_nr"))
    )
    # At most one row per part of the query.
    heaviest = Window.partitionBy("consulta").orderBy(F.desc("_nr"), "_k")
    dropped = heavy.withColumn("_nth", F.row_number().over(heaviest)).filter(
        F.col("_nth") <= spare
    )
    return queries.join(dropped.hint("merge"), ["consulta", "_k"], "left_anti")


def _verified(
    queries: DataFrame, names: DataFrame, keys: list[str], *, broadcast: bool = False
) -> DataFrame:
    distance = F.expr("levenshtein(consulta, nombre, _t)")
    # The planner takes exploded keys to be as small as the names they are from,
    # so it must not choose to broadcast them on its own.
    told = names.select("nombre", "primero", "n_low", "n_high", *keys).hint("merge")
    asked = queries.select("consulta", "_t", "q_low", "q_high", *keys)
    if broadcast:
        asked, told = F.broadcast(asked), names.select(*told.columns)
    return (
        asked.join(told, keys)
        .filter(_near_signatures("q", "n"))
        .filter(distance >= 0)
        .select("consulta", F.struct(distance.alias("d"), "primero").alias("hallado"))
    )


def _blocks(queries: DataFrame, names: DataFrame, pairs: int) -> DataFrame:
    """Join frequent keys in blocks of at most ``pairs`` candidate pairs each."""
    side = max(1, math.isqrt(pairs))
    rows = F.ceil(F.col("_nq") / side).cast("int")
    cols = F.ceil(F.col("_nr") / side).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = queries.withColumn("_row", F.pmod(F.xxhash64("consulta"), rows).cast("int")).withColumn(
        "_col", every(cols)
    )
    right = names.withColumn("_col", F.pmod(F.xxhash64("nombre"), cols).cast("int")).withColumn(
        "_row", every(rows)
    )
    return _verified(left, right, [*KEY, "_row", "_col"])


@dataclass
class _Span:
    """What is known of the open queries before they are cut in parts."""

    n: int
    lengths: list[int]  # that occur, at most one value per length
    key_bytes: int  # of all keys of their own limits, without spare parts


def _span(queries: DataFrame) -> _Span:
    length, size = F.length("consulta"), F.octet_length("consulta")
    keys = 2 * length + accepted_edits(length) / 2 + 1
    row = queries.agg(
        F.count("*").alias("n"),
        F.collect_set(length).alias("lengths"),
        F.ceil(F.sum(keys * (2 * size + KEY_OVERHEAD))).alias("key_bytes"),
    ).first()
    return _Span(row["n"], sorted(row["lengths"]), row["key_bytes"] or 0)


def _candidates(
    queries: DataFrame,
    names: DataFrame,
    span: _Span,
    n_names: int,
    cap: int | None,
    pairs: int,
) -> list[DataFrame]:
    """Verified pairs of all queries; together they hold each pair within reach."""
    found = []
    for spare in range(MOST_SPARE_PARTS + 1):
        asked = _query_keys(queries, cap, spare)
        told = _roster_keys(names, cap, span.lengths, spare)
        frequent = None
        # Within one edit, a key holds as many texts as there are letters at most.
        if cap != 1 and span.n * n_names > pairs:
            frequent = _frequent(asked, told, n_names, pairs)
        if frequent is None:
            return [*found, _verified(asked, told, KEY)]
        small = measured(frequent)
        key = F.xxhash64(*KEY)
        asked, told = asked.withColumn("_hash", key), told.withColumn("_hash", key)
        if spare:
            asked = _without_heaviest(asked, frequent, spare)
        # Queries with a frequent part are cut finer as long as the parts stay
        # long enough, and go in blocks otherwise.
        finer = F.lit(spare < MOST_SPARE_PARTS) & (
            F.col("_len") >= LEAST_PART * _parts(spare + 1)
        )
        crowded = stored(
            asked.join(small, "_hash", "left_semi")
            .select(*queries.columns, finer.alias("_finer"))
            .distinct()
        )
        queries = _spread(crowded.filter("_finer").drop("_finer"), "consulta")
        asked = asked.join(queries.select("consulta"), "consulta", "left_anti")
        found.append(_verified(asked.join(small, "_hash", "left_anti"), told, KEY))
        if not crowded.filter("not _finer").isEmpty():
            found.append(_blocks(asked.join(small, "_hash"), told.join(small, "_hash"), pairs))
        span = _span(queries)
        if not span.n:
            break
    return found


def nearest_names(
    queries: DataFrame,
    names: DataFrame,
    *,
    steps: tuple[int | None, ...] = STEPS,
    pairs_per_task: int = PAIRS_PER_TASK,
    few_pairs: int = FEW_PAIRS,
) -> DataFrame:
    """``consulta``, ``d`` and ``primero`` for each query that has an accepted name.

    ``queries`` holds distinct ``consulta`` of at least ``SHORTEST_NAME``
    characters; ``names`` holds distinct ``nombre`` with an orderable ``primero``
    that decides ties.
    """
    names = stored(names.withColumns(_signatures("n", "nombre")))
    n_names = names.count()
    equal = names.select(F.col("nombre").alias("consulta"), F.col("primero"))
    found = F.when(F.col("primero").isNotNull(), F.struct(F.lit(0).alias("d"), "primero"))
    names = _spread(names, "nombre")
    state = stored(
        lookup_join(queries, equal, ["consulta"], spread=False)
        .withColumns({**_signatures("q", "consulta"), "hallado": found})
        .drop("primero")
    )
    done = [state.filter("hallado is not null")]
    covered = 0
    for cap in steps:
        # Names whose own limit a former step has covered stay unlinked.
        open_ = state.filter("hallado is null").drop("hallado")
        open_ = _spread(open_.filter(accepted_edits(F.length("consulta")) > covered), "consulta")
        span = _span(open_)
        if not span.n or not n_names:
            break
        # Few keys go to every task; the roster stays where it is.
        few = span.n * n_names <= few_pairs and span.key_bytes <= broadcast_limit(names)
        if span.n * n_names <= few_pairs // 50:
            cap = None
        if few:
            asked, told = _query_keys(open_, cap, 0), _roster_keys(names, cap, span.lengths, 0)
            pairs = _verified(asked, told, KEY, broadcast=True)
        else:
            first, *others = _candidates(open_, names, span, n_names, cap, pairs_per_task)
            pairs = reduce(DataFrame.union, others, first)
        best = pairs.groupBy("consulta").agg(F.min("hallado").alias("hallado"))
        state = stored(open_.join(best, "consulta", "left"))
        done.append(state.filter("hallado is not null"))
        if cap is None:
            break
        covered = cap
    linked = reduce(DataFrame.union, done)
    return linked.select("consulta", "hallado.d", "hallado.primero")


def roster_names(roster: DataFrame) -> DataFrame:
    """Distinct lower-case roster names with the order and dni of their first row."""
    return roster.groupBy(F.lower(known(F.col("nombre"))).alias("nombre")).agg(
        F.min(F.struct("seq", "dni")).alias("primero")
    )


def link_by_name(
    rows: DataFrame,
    roster: DataFrame,
    *,
    steps: tuple[int | None, ...] = STEPS,
    pairs_per_task: int = PAIRS_PER_TASK,
    few_pairs: int = FEW_PAIRS,
    broadcast: bool | None = None,
) -> DataFrame:
    """Give unmatched rows the dni of the roster person with the nearest name.

    Linked rows get method ``IA``, also over ``MANUAL``. ``vinculado`` tells
    which rows were linked by this call.
    """
    person = lookup(rows, roster, "left", broadcast=broadcast)
    query = search_name(F.col("nombre"))
    asks = F.col("oficial").isNull() & (F.length(query) >= SHORTEST_NAME)
    asking = person.withColumn("consulta", F.when(asks, query)).drop("oficial")
    queries = asking.filter("consulta is not null").select("consulta").distinct()
    links = nearest_names(
        queries,
        roster_names(roster),
        steps=steps,
        pairs_per_task=pairs_per_task,
        few_pairs=few_pairs,
    ).select("consulta", F.col("primero.dni").alias("_dni"))
    linked = F.col("_dni").isNotNull()
    return (
        lookup_join(asking, links, ["consulta"], "left")
        .withColumns(
            {
                "dni": F.coalesce("_dni", "dni"),
                "method": F.when(linked, F.lit("IA")).otherwise(F.col("method")),
                "vinculado": linked,
            }
        )
        .drop("consulta", "_dni")
    )


def link_count(linked: DataFrame) -> DataFrame:
    """Number of rows linked by :func:`link_by_name`."""
    return linked.agg(F.count_if("vinculado").alias("vinculados"))
