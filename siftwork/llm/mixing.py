"""Operator 2: interleave sources to target weights by Pfair windows and earliest deadline first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.common import table, with_offsets

#: Weights are kept in so many parts of their sum.
WEIGHT_UNITS = 1 << 30
#: Slots whose blocks one row folds out, beside the others, once the states at the borders of such pieces are known.
PIECE = 2048
#: Entries of a source and a border that one task folds over: pieces are longer where there would be more. A fold keeps them in chunks.
BORDERS, CHUNK = 1 << 21, 256
BLOCK_ROWS = 16
#: Rows of a source are ranked in so many buckets, so a hot source is not one task.
RANK_DIGITS = 3


def source_plan(docs: DataFrame, source: Column, weights: dict[str, float] | None, temperature: float, block_rows: int) -> DataFrame:
    """One row per source: rows, blocks, tier and integer weight.

    Without ``weights`` a source weighs its row count to the power ``temperature``. A source without a weight, or
    with weight 0, is in tier 1, which comes after all others; there it weighs its number of blocks. A weight is
    rounded to 1 / ``WEIGHT_UNITS`` of its tier's sum, which is less than a block for up to 2 * 10^9 blocks.
    """
    counts = docs.groupBy(source.alias("source_key")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature))))
    else:
        if any(not 0 <= w < float("inf") for w in weights.values()):
            raise ValueError("target weights must be finite and not negative")
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "of_key string, weight double")
        # as many rows as the caller names
        weighed = counts.join(F.broadcast(given), F.col("source_key") == F.col("of_key"), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    blocks = F.ceil(F.col("n_rows") / block_rows).cast("long")
    tiered = weighed.select(
        "source_key", "n_rows", blocks.alias("n_blocks"), F.when(F.col("weight") > 0, 0).otherwise(1).alias("tier"),
        F.when(F.col("weight") > 0, F.col("weight")).otherwise(blocks.cast("double")).alias("weight"),
    )
    total = tiered.groupBy(F.col("tier").alias("of_tier")).agg(F.sum("weight").alias("total"))  # two rows
    units = F.greatest(F.lit(1), F.round(F.col("weight") / F.col("total") * WEIGHT_UNITS).cast("long"))
    return tiered.join(F.broadcast(total), F.col("tier") == F.col("of_tier")).select("source_key", "n_rows", "n_blocks", "tier", units.alias("units"))


_NEVER = "9223372036854775807L"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0L, (sum_so_far, term) -> sum_so_far + term)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and calls it ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fluid(s: str, i: str) -> str:
    """SQL of units[s] times the slots that the fluid schedule needs until source s has emitted i blocks."""
    return _sum(f"transform(n, (n_j, j) -> least(n_j * u[{s}], ({i}) * u[j]))")


def _head(s: str, i: str) -> str:
    """SQL of block i of source s: released when the fluid schedule starts it, due when that ends it; never where there is none."""
    window = f"named_struct('i', {i}, 'release', {_fluid(s, f'{i} - 1')} div u[{s}], 'deadline', ({_fluid(s, i)} + u[{s}] - 1) div u[{s}])"
    return f"if({i} > n[{s}], named_struct('i', {i}, 'release', {_NEVER}, 'deadline', {_NEVER}), {window})"


def _at(name: str, t: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` tells the fluid schedule at slot t: blocks of the sources that ran out, units of the others."""
    gone = _sum(f"transform(n, (n_j, j) -> if(ends[j] <= {t} * u[j], n_j, 0L))")
    wide = _sum(f"transform(u, (u_j, j) -> if(ends[j] > {t} * u_j, u_j, 0L))")
    return _let(name, f"named_struct('t', {t}, 'gone', {gone}, 'wide', greatest(1L, {wide}))", body)


def _ended(s: str, at: str) -> str:
    """SQL of the blocks of source s that the fluid schedule has ended by then."""
    return f"if(ends[{s}] <= {at}.t * u[{s}], n[{s}], u[{s}] * ({at}.t - {at}.gone) div {at}.wide)"


def _started(s: str, at: str) -> str:
    """SQL of the blocks of source s that the fluid schedule has started by then."""
    return f"if(ends[{s}] <= {at}.t * u[{s}], n[{s}], (u[{s}] * ({at}.t - {at}.gone) + {at}.wide - 1L) div {at}.wide)"


def _border() -> str:
    """SQL of what one border between pieces, ``below`` to ``upto``, asks of the blocks under way at its end.

    ``need`` of them have a slot before the end. ``runners`` are these blocks by deadline, then source; a runner is
    old when it was under way at the piece's start as well. ``limits``: of the runners released at ``level`` or
    later, not more than ``room`` have a slot before the end, as the blocks due by then fill the others.
    """
    runner = (
        f"transform(array({_head('s', 'ended[s] + 1L')}), h -> named_struct('deadline', h.deadline, 's', s, 'old', was[s] > ended[s], 'release', h.release))[0]"
    )
    runners = f"array_sort(filter(transform(n, (n_s, s) -> if({_started('s', 'fin')} > ended[s], {runner}, null)), r -> r is not null))"
    levels = "array_sort(array_distinct(transform(filter(runners, r -> not r.old and r.release > below), r -> r.release)))"
    taken_up = _sum(f"transform(n, (n_s, s) -> greatest(0L, ended[s] - {_started('s', 'now')}))")
    rooms = f"if(size(levels) = 0, cast(array() as array<bigint>), transform(sequence(below + 1L, element_at(levels, -1)), t -> {_at('now', 't', f'upto - t - {taken_up}')}))"
    limit = (
        "transform(levels, (l, x) -> named_struct('level', l, 'room', array_min(slice(rooms, "
        "cast(if(x = 0, below, levels[x - 1]) - below + 1L as int), cast(l - if(x = 0, below, levels[x - 1]) as int)))))"
    )
    limits = f"filter({limit}, q -> q.room < size(filter(runners, r -> not r.old and r.release >= q.level)))"
    asked = f"named_struct('need', cast(upto - {_sum('ended')} as int), 'runners', runners, 'limits', limits)"
    asked = _let("runners", runners, _let("levels", levels, _let("rooms", rooms, _let("limits", limits, asked))))
    was = _at("ini", "below", f"transform(n, (n_s, s) -> {_started('s', 'ini')})")
    return _let("was", was, _at("fin", "upto", _let("ended", f"transform(n, (n_s, s) -> {_ended('s', 'fin')})", asked)))


def _ahead() -> str:
    """SQL of the sources whose block under way has its slot already, at the start of every piece: a fold over the borders.

    Earliest deadline first gives a runner a slot before the border exactly if one is left beside the runners due
    before it, so runners are taken by deadline as long as ``need`` and ``limits`` allow.
    """
    took = (
        "named_struct('taken', concat(st.taken, array(r.s)), "
        "'limits', if(r.old, st.limits, transform(st.limits, q -> named_struct('level', q.level, 'room', q.room - cast(q.level <= r.release as bigint)))))"
    )
    full = "size(st.taken) >= border.need or (r.old and array_contains(st.taken, r.s)) or (not r.old and exists(st.limits, q -> q.level <= r.release and q.room <= 0L))"
    kept = "transform(filter(border.runners, r -> r.old and array_contains(prior, r.s)), r -> r.s)"
    step = f"aggregate(border.runners, named_struct('taken', {kept}, 'limits', border.limits), (st, r) -> if({full}, st, {took}), st -> st.taken)"
    # a chunk's states are put together first, as every concat copies what it extends
    step = f"concat(part, array({_let('prior', 'element_at(part, -1)', step)}))"
    chunk = f"aggregate(slice(borders, c * {CHUNK} + 1, {CHUNK}), array(reached), (part, border) -> {step})"
    chunk = _let("reached", "element_at(element_at(done, -1), -1)", f"slice({chunk}, 2, {CHUNK})")
    first = "array(array(cast(array() as array<int>)))"
    return f"flatten(aggregate(sequence(0, (size(borders) - 1) div {CHUNK}), {first}, (done, c) -> concat(done, array({chunk}))))"


#: SQL of the source whose head takes slot ``t``: the earliest deadline among the released heads, ties to the first source.
_PICK = "array_min(filter(transform(heads, (h, x) -> if(h.release <= t, named_struct('d', h.deadline, 'x', x), null)), y -> y is not null)).x"
_AFTER = f"transform(heads, (h, x) -> if(x = p, {_head('x', 'h.i + 1')}, h))"


def schedule(plan: DataFrame) -> DataFrame:
    """One row per block: (of_source, of_block, release, deadline, slot).

    The fluid schedule gives every source its weight's share of each slot until it runs out; then the others
    keep their ratio. Block i of a source is released in the slot in which the fluid schedule starts it and due
    when it ends it. Earliest deadline first among released blocks (ties: first source in order) gives each
    block a slot in its window, so no source is ever a whole block away from its share. All is exact in 64-bit integers.

    The slots are cut into pieces of ``PIECE`` (longer ones where there would be over ``BORDERS`` entries of a source and
    a border). At a border each source has at most one block under way; all blocks due before have their slots. Which blocks
    under way have theirs too follows from what was so a border earlier and from counts over the windows in the
    piece (``_border``). The counts are taken piece by piece in parallel, one task folds over the borders
    (``_ahead``), and then the slots of all pieces are dealt in parallel.
    """
    tiers = plan.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("source_key", "n_blocks", "units"))).alias("src"))
    # two rows at most, with one entry for each source
    tiers = tiers.select(
        "tier", F.transform("src", lambda x: x["source_key"]).alias("keys"), F.transform("src", lambda x: x["n_blocks"]).alias("n"),
        F.transform("src", lambda x: x["units"]).alias("u"),
    )
    before = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    tiers = tiers.withColumn("stop", F.expr(_sum("n"))).withColumn("base", F.coalesce(F.sum("stop").over(before), F.lit(0)).cast("long"))
    tiers = tiers.select(
        "*", F.expr(f"greatest({PIECE}L, (stop * size(n)) div {BORDERS}L + 1L)").alias("piece"),
        F.expr(f"transform(n, (n_s, s) -> {_fluid('s', 'n_s')})").alias("ends"),
    )
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions keeps small rows of much work apart
    pieces = tiers.select("*", F.expr("explode(sequence(0L, (stop - 1L) div piece)) as k")).repartition(parts, "tier", "k")
    borders = pieces.select("*", F.expr("k * piece as below"), F.expr("(k + 1L) * piece as upto")).where("upto < stop")
    met = borders.select("tier", "k", F.expr(_border()).alias("border")).groupBy("tier").agg(F.array_sort(F.collect_list(F.struct("k", "border"))).alias("met"))
    # outer: the filter that a plain explode implies would be pushed below and repeat the folds inside it
    states = met.select(F.col("tier").alias("of_tier"), F.posexplode_outer(F.expr(_let("borders", "transform(met, x -> x.border)", _ahead()))).alias("of_k", "taken"))
    begun = pieces.join(states, (F.col("tier") == F.col("of_tier")) & (F.col("k") == F.col("of_k")), "left")
    begun = begun.select("base", "keys", "n", "u", "ends", F.expr("k * piece as below"), F.expr("least(stop, (k + 1L) * piece) as upto"), "taken")
    next_block = f"{_ended('s', 'ini')} + if(array_contains(coalesce(taken, cast(array() as array<int>)), s), 2L, 1L)"
    heads = _at("ini", "below", f"transform(n, (n_s, s) -> {_let('i', next_block, _head('s', 'i'))})")
    taken = _let(
        "heads", "st.heads",
        _let("p", _PICK, f"named_struct('heads', {_AFTER}, 'out', concat(st.out, array(named_struct('x', p, 'h', heads[p]))))"),
    )
    out = "cast(array() as array<struct<x:int,h:struct<i:bigint,release:bigint,deadline:bigint>>>)"
    fold = f"aggregate(sequence(below, upto - 1L), named_struct('heads', {heads}, 'out', {out}), (st, t) -> {taken}, st -> st.out)"
    folded = begun.select("base", "keys", "below", F.expr(fold).alias("slots"))
    slots = folded.select("base", "keys", "below", F.posexplode_outer("slots").alias("at", "block"))
    return slots.select(
        F.expr("keys[block.x]").alias("of_source"), (F.col("block.h.i") - 1).alias("of_block"), (F.col("base") + F.col("block.h.release")).alias("release"),
        (F.col("base") + F.col("block.h.deadline")).alias("deadline"), (F.col("base") + F.col("below") + F.col("at")).alias("slot"),
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """A global order of all rows in which every prefix has the target mix to within one block.

    Within its source a row's place is its rank by md5 of the id (then the id); ``block_rows`` rows in a
    row make a block, the last block of a source may be short. Blocks are interleaved by ``schedule``; when a
    source runs out the others keep their ratio, so every row is placed once and none is dropped or repeated.
    Rows with a null source form a source of their own; sources without a target weight, or with weight 0, come
    after all others. Repeated ids take places of their own; text is not looked at. An empty table gives an empty
    result; other columns are ignored.

    Returns id, source, ``block`` (of the source, from 0), ``release`` and ``deadline`` (global slots),
    ``slot`` (the block's place in the mix, from 0 without gaps) and ``seq`` (the row's place in its
    block); with ``carry`` also ``row``, a struct of all the input's columns. What is broadcast has one entry for each source.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    if weights is not None:
        weights = {f"={k}": w for k, w in weights.items()}
    plan = source_plan(docs, key, weights, temperature, block_rows)
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        key.alias("source_key"),
        digest.alias("digest"),
        F.substring(digest, 1, RANK_DIGITS).alias("digits"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []),
    )
    # The buckets of one source are few, so their offsets need one task a source.
    cells = rows.groupBy("source_key", "digits").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source_key", "digits", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"))
    # the slots of a cell's blocks, in order: the rows themselves are not shuffled by block
    held = cells.select("*", F.expr(f"explode(sequence(cell_start div {block_rows}L, (cell_start + n - 1) div {block_rows}L)) as block"))
    slots = (
        held.join(schedule(plan), (F.col("source_key") == F.col("of_source")) & (F.col("block") == F.col("of_block")))
        .groupBy(F.col("source_key").alias("cell_source"), F.col("digits").alias("cell_digits"))
        .agg(F.first("cell_start").alias("cell_start"), F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("slots"))
    )
    rank = F.row_number().over(Window.partitionBy("source_key", "digits").orderBy("digest", "id")) - 1
    ranked = rows.withColumn("in_cell", rank).join(
        slots, (F.col("source_key") == F.col("cell_source")) & (F.col("digits") == F.col("cell_digits"))
    )
    carried = ["row"] if carry else []
    placed = ranked.select(
        *carried, "id", "source", F.expr(f"slots[cast((cell_start + in_cell) div {block_rows}L - cell_start div {block_rows}L as int)]").alias("at"),
        F.expr(f"cast((cell_start + in_cell) % {block_rows}L as int)").alias("seq"),
    )
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "at.block", "at.release", "at.deadline", "at.slot", "seq", *carried
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows themselves, with all their columns, laid out in the mixed order.

    Output files follow the order of the mix: equal runs of slots make the partitions, each sorted by slot
    and place in the block.
    """
    places = mix_sources(docs, carry=True, **options)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block_rows = options.get("block_rows", BLOCK_ROWS)
    source = F.col(options.get("source_col", "source"))
    n_slots = docs.groupBy(source).count().agg(F.sum(F.ceil(F.col("count") / block_rows))).first()[0] or 1
    part = F.least(F.expr(f"cast(slot * {parts} div {n_slots} as int)"), F.lit(parts - 1))
    return places.repartitionById(parts, part).sortWithinPartitions("slot", "seq").select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def _emitted_sql(i: str) -> str:
    """SQL of u[x] times the slots that the fluid schedule needs for i blocks of source x."""
    return f"list_sum(list_transform(range(1, len(n) + 1), lambda j: least(n[j] * u[x], ({i}) * u[j])))::bigint"


OP2_SQL = f"""
with recursive keyed as (
  select doc_id, source, case when source is null then '' else '=' || source end as k, md5(coalesce(doc_id::varchar, '')) as d from documents
), counts as (
  select k, count(*) as n_rows from keyed group by k
), plan as (
  select k, ((n_rows + {BLOCK_ROWS - 1}) // {BLOCK_ROWS})::bigint as nb,
         greatest(1, round(pow(n_rows, 0.5) / (select sum(pow(n_rows, 0.5)) from counts) * {WEIGHT_UNITS}))::bigint as units
  from counts
), src as (
  select list(k order by k) as ks, list(nb order by k) as n, list(units order by k) as u from plan
), blocks as (
  select k, x, i, {_emitted_sql('i - 1')} // u[x] as rel, ({_emitted_sql('i')} + u[x] - 1) // u[x] as due
  from (select *, unnest(range(1, n[x] + 1)) as i from (select *, unnest(range(1, len(ks) + 1)) as x, unnest(ks) as k from src))
), windows as (
  select list(rel) as rels, list(due) as dues, x from (select * from blocks order by x, i) group by x
), all_windows as (
  select list(rels order by x) as rel, list(dues order by x) as due, sum(len(rels))::bigint as total from windows
), slots as (
  select 0::bigint as t, list_transform(rel, lambda r: 0::bigint) as heads, 0::bigint as x from all_windows
  union all
  select t + 1, list_transform(range(1, len(heads) + 1), lambda j: heads[j] + (j = p)::bigint), p
  from (select t, heads, list_min(list_transform(list_filter(range(1, len(heads) + 1), lambda x: heads[x] < len(rel[x]) and rel[x][heads[x] + 1] <= t),
                                                 lambda x: due[x][heads[x] + 1] * 1000000 + x)) % 1000000 as p
        from slots, all_windows where t < total)
), placed as (
  select ks[x] as k, heads[x] - 1 as block, t - 1 as slot from slots, src where x > 0
), ranked as (
  select *, row_number() over (partition by k order by d, doc_id) - 1 as r from keyed
)
select doc_id, source, r // {BLOCK_ROWS} as block, rel as release, due as deadline, slot, (r % {BLOCK_ROWS})::int as seq
from ranked q join placed p on q.k = p.k and r // {BLOCK_ROWS} = p.block join blocks b on b.k = q.k and b.i = p.block + 1
"""
