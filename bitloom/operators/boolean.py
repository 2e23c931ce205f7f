"""Two-level Boolean minimisation as joins, anti-joins and grouped sums.

A function is a set of rows; every operator works on many functions at once, keyed
by ``fn``.  A cube is ``(mask, value)``: mask bits are fixed, value holds them.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.bits import ceil_log2, contains_cube, covers, popcount
from bitloom.sources.tables import keep


def states(table: DataFrame) -> DataFrame:
    """``fn, minterm, out, dc`` -> ``fn, minterm, state``: don't-care wins over on."""
    return table.select("fn", "minterm", F.when(F.col("dc"), "DC").when(F.col("out") != 0, "ON").otherwise("OFF").alias("state"))


def canonical(on: DataFrame, dc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets; on wins over don't-care."""
    on = on.select("fn", "minterm").distinct()
    return on, dc.select("fn", "minterm").distinct().join(on, ["fn", "minterm"], "left_anti")


def distinct_cubes(cubes: DataFrame) -> DataFrame:
    return cubes.select("fn", "mask", "value").distinct()


def merge_level(cubes: DataFrame, bits: int) -> DataFrame:
    """Cubes one literal shorter: two cubes of one mask that differ in one bit become one.

    No self-join: each cube is filed under itself without each of its bits; a file
    of two is a merge.  Rows: ``fn, mask, value`` merged."""
    filed = cubes.select("fn", "mask", "value", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("i"))
    filed = filed.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("i"))).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    filed = filed.groupBy("fn", (F.col("mask") - F.col("bit")).alias("mask"), "bit", F.col("value").bitwiseAND(F.bitwise_not("bit")).alias("value")).agg(F.count("*").alias("n"))
    return filed.where("n = 2").select("fn", "mask", "value").distinct()


def implicants(allowed: DataFrame, bits: int) -> DataFrame:
    """All cubes that cover allowed minterms only, level by level."""
    full = (1 << bits) - 1
    level = allowed.select("fn", F.lit(full).alias("mask"), F.col("minterm").cast("int").alias("value")).distinct()
    out = level
    for _ in range(bits):
        level = merge_level(level, bits)
        out = out.union(level)
    return out


def cube_implicants(allowed: DataFrame, bits: int) -> DataFrame:
    """All implicants in one pass by CUBE over the bits: a cell is one if it is full."""
    names = [f"b{i}" for i in range(bits)]
    wide = allowed.select("fn", *[F.expr(f"(minterm >> {i}) & 1").alias(f"b{i}") for i in range(bits)]).distinct()
    cells = wide.cube("fn", *names).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    cells = cells.where(F.col("fn").isNotNull())
    free = F.lit(0)
    mask, value = F.lit(0), F.lit(0)
    for i, name in enumerate(names):
        fixed = F.col(name).isNotNull()
        free = free + F.when(fixed, 0).otherwise(1)
        mask = mask + F.when(fixed, 1 << i).otherwise(0)
        value = value + F.coalesce(F.col(name), F.lit(0)) * (1 << i)
    return cells.where(F.col("n") == F.call_function("shiftleft", F.lit(1), free)).select("fn", mask.cast("int").alias("mask"), value.cast("int").alias("value"))


def primes(allowed: DataFrame, bits: int) -> DataFrame:
    """Implicants that no shorter implicant covers.

    A cube is prime if dropping none of its bits leaves an implicant, so the check is
    an equi-join on one-bit-shorter cubes, not a containment join of all pairs."""
    every = cube_implicants(allowed, bits)
    shorter = every.select("fn", "mask", "value", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("i"))
    shorter = shorter.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("i"))).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    shorter = shorter.select("fn", F.col("mask").alias("m"), F.col("value").alias("v"), (F.col("mask") - F.col("bit")).alias("mask"), F.col("value").bitwiseAND(F.bitwise_not("bit")).alias("value"))
    beaten = shorter.join(every, ["fn", "mask", "value"], "left_semi").select("fn", F.col("m").alias("mask"), F.col("v").alias("value"))
    return every.join(beaten, ["fn", "mask", "value"], "left_anti")


def chart(cubes: DataFrame, on: DataFrame) -> DataFrame:
    """Which cube covers which on-minterm: ``fn, mask, value, minterm``."""
    c, o = cubes.alias("c"), on.select("fn", "minterm").alias("o")
    return c.join(o, (F.col("c.fn") == F.col("o.fn")) & covers(F.col("c.mask"), F.col("c.value"), F.col("o.minterm"))).select("c.fn", "c.mask", "c.value", "o.minterm")


def useful(cubes: DataFrame, on: DataFrame) -> DataFrame:
    """Cubes that cover at least one on-minterm."""
    c, o = cubes.alias("c"), on.select("fn", "minterm").alias("o")
    return c.join(o, (F.col("c.fn") == F.col("o.fn")) & covers(F.col("c.mask"), F.col("c.value"), F.col("o.minterm")), "left_semi")


def essential(cubes: DataFrame, on: DataFrame) -> DataFrame:
    """Cubes that alone cover some on-minterm.

    One pass is the fixed point: a minterm that these leave uncovered has two cubes or more, none
    of them chosen, so no further cube is forced."""
    only = chart(cubes, on).groupBy("fn", "minterm").agg(F.count("*").alias("n"), F.first("mask").alias("mask"), F.first("value").alias("value"))
    return only.where("n = 1").select("fn", "mask", "value").distinct()


def guarded(cubes: DataFrame, allowed: DataFrame, bits: int) -> DataFrame:
    """Cubes all of whose minterms are allowed: they cover 2**free allowed ones."""
    hit = chart(cubes, allowed.distinct()).groupBy("fn", "mask", "value").agg(F.count("*").alias("n"))
    return hit.where(F.col("n") == F.call_function("shiftleft", F.lit(1), F.lit(bits) - popcount(F.col("mask")))).select("fn", "mask", "value")


def absorb(cubes: DataFrame) -> DataFrame:
    """Cubes that lie inside no other cube of the cover."""
    a, b = distinct_cubes(cubes).alias("a"), distinct_cubes(cubes).alias("b")
    other = (F.col("a.mask") != F.col("b.mask")) | (F.col("a.value") != F.col("b.value"))
    inside = contains_cube(F.col("b.mask"), F.col("b.value"), F.col("a.mask"), F.col("a.value"))
    return a.join(b, (F.col("a.fn") == F.col("b.fn")) & other & inside, "left_anti")


def consensus(cubes: DataFrame, allowed: DataFrame, bits: int) -> DataFrame:
    """Legal merges of two cubes of a cover that differ in one bit."""
    return guarded(merge_level(distinct_cubes(cubes), bits), allowed, bits)


def redundant(cubes: DataFrame, dc: DataFrame, bits: int) -> DataFrame:
    """Cubes whose minterms are all covered by other cubes or don't-care."""
    cubes = distinct_cubes(cubes)
    every = cubes.select("fn").distinct().withColumn("minterm", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))
    hit = chart(cubes, every)
    lonely = hit.withColumn("n", F.count("*").over(Window.partitionBy("fn", "minterm"))).where("n = 1").join(dc.select("fn", "minterm"), ["fn", "minterm"], "left_anti")
    return cubes.join(lonely.select("fn", "mask", "value").distinct(), ["fn", "mask", "value"], "left_anti")


def irredundant_step(cubes: DataFrame, on: DataFrame) -> DataFrame:
    """Cubes each of whose on-minterms another cube covers too; any one of them may go."""
    hit = chart(distinct_cubes(cubes), on).withColumn("n", F.count("*").over(Window.partitionBy("fn", "minterm")))
    kept = hit.where("n = 1").select("fn", "mask", "value").distinct()
    return distinct_cubes(cubes).join(kept, ["fn", "mask", "value"], "left_anti")


OBJECTIVES = ("literals", "area", "delay", "lut4", "lut6")


def cube_weight(mask, objective: str):
    """Cost of one cube under an objective; a cube counts one literal at least."""
    lits = F.greatest(popcount(mask), F.lit(1))
    return {
        "literals": lits.cast("double"), "area": lits + F.lit(0.8), "delay": (ceil_log2(lits) + 1).cast("double"),
        "lut4": F.ceil(lits / 4).cast("double"), "lut6": F.ceil(lits / 6).cast("double"),
    }[objective]


def cover_costs(cubes: DataFrame) -> DataFrame:
    """Gates, levels, lookup tables and the cost of each function's cover under every objective.

    Two-input gates in balanced trees, an inverter per input that occurs negated,
    lookup tables of 4 and 6 inputs for terms and for the final OR."""
    c = distinct_cubes(cubes).withColumn("lits", popcount(F.col("mask"))).withColumn("inv", F.col("mask").bitwiseAND(F.bitwise_not("value")))
    tables = lambda k: F.sum(F.ceil(F.greatest(F.col("lits"), F.lit(1)) / k))
    many = F.col("terms") > 1
    out = c.groupBy("fn").agg(
        F.count("*").alias("terms"), F.sum("lits").cast("long").alias("literals"), popcount(F.bit_or("inv")).cast("long").alias("inverters"),
        F.sum(F.greatest(F.col("lits") - 1, F.lit(0))).alias("inside"), F.max(ceil_log2(F.col("lits")) + 1).alias("deep"), tables(4).alias("t4"), tables(6).alias("t6"),
    )
    out = out.withColumn("gates", (F.col("inside") + F.when(many, F.col("terms") - 1).otherwise(0)).cast("long"))
    out = out.withColumn("levels", (F.col("deep") + F.when(many, ceil_log2(F.col("terms"))).otherwise(0)).cast("long"))
    for k in (4, 6):
        out = out.withColumn(f"luts{k}", (F.col(f"t{k}") + F.when(many, F.ceil(F.col("terms") / k)).otherwise(0)).cast("long"))
    return out.select(
        "fn", "terms", "literals", "gates", "inverters", "levels", "luts4", "luts6", (F.col("gates") + F.col("inverters") * 0.2).alias("area"),
        (F.col("levels") + F.col("gates") * 0.01).alias("delay"), (F.col("luts4") + F.col("levels") * 0.05).alias("cost4"), (F.col("luts6") + F.col("levels") * 0.05).alias("cost6"),
    )


def better(costs: DataFrame, by: str) -> DataFrame:
    """The cheapest of several covers of a function: ``fn, cover`` and costs; ties go to
    fewer literals, fewer terms, the smaller name."""
    order = Window.partitionBy("fn").orderBy(F.round(by, 9), "literals", "terms", "cover")
    return costs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def greedy_cover(cubes: DataFrame, on: DataFrame) -> DataFrame:
    """``fn, mask, value, turn``: a cover chosen step by step, for each function at once.

    ``cubes`` may have a column ``weight`` (literals otherwise).  Each turn takes the cube with the
    largest merit, which is newly covered minterms by weight; ties go to more minterms, then to the
    smaller mask and value.  Every turn's choice is written to the shared folder."""
    if "weight" not in cubes.columns:
        cubes = cubes.withColumn("weight", cube_weight(F.col("mask"), "literals"))
    hits = keep(_hits(cubes.select("fn", "mask", "value", "weight").distinct(), on.select("fn", "minterm").distinct()), "hits")
    left, turns = hits, []
    while True:
        gain = left.groupBy("fn", "mask", "value").agg(F.count("*").alias("gain"), F.min("weight").alias("w"))
        best = gain.groupBy("fn").agg(F.max(F.struct((F.col("gain") / F.col("w")).alias("merit"), "gain", (-F.col("mask")).alias("m"), (-F.col("value")).alias("v"))).alias("x"))
        best = keep(best.select("fn", (-F.col("x.m")).alias("mask"), (-F.col("x.v")).alias("value"), F.lit(len(turns)).alias("turn")), "turn")
        if not best.take(1):
            return reduce(DataFrame.union, turns, best)
        turns.append(best)
        done = hits.join(reduce(DataFrame.union, turns), ["fn", "mask", "value"], "left_semi").select("fn", "minterm")
        left = hits.join(done, ["fn", "minterm"], "left_anti")


def _hits(cubes: DataFrame, minterms: DataFrame) -> DataFrame:
    """Rows of ``cubes`` by the minterms that they cover."""
    c, o = cubes.alias("c"), minterms.alias("o")
    return c.join(o, (F.col("c.fn") == F.col("o.fn")) & covers(F.col("c.mask"), F.col("c.value"), F.col("o.minterm"))).select("c.*", "o.minterm")


def prune_in_order(cubes: DataFrame, need: DataFrame) -> DataFrame:
    """``fn, mask, value`` that stay when the cubes of each function are gone through by ``place`` and
    each goes whose needed minterms (``fn, minterm``) others that are still there cover too.

    The order matters, so a function's cubes meet in one row (at most 3**bits of them) and one fold
    over them carries how often each minterm is covered."""
    hit = _hits(cubes.select("fn", "mask", "value", "place"), need.select("fn", "minterm").distinct())
    own = hit.groupBy("fn", "mask", "value").agg(F.collect_set("minterm").alias("mins"))
    rows = cubes.select("fn", "mask", "value", "place").join(own, ["fn", "mask", "value"], "left").withColumn("mins", F.coalesce("mins", F.array().cast("array<int>")))
    rows = rows.groupBy("fn").agg(F.array_sort(F.collect_list(F.struct("place", "mask", "value", "mins"))).alias("cubes"))
    times = hit.groupBy("fn", "minterm").agg(F.count("*").cast("int").alias("n")).groupBy("fn").agg(F.map_from_entries(F.collect_list(F.struct("minterm", "n"))).alias("times"))
    rows = rows.join(times, "fn", "left").withColumn("times", F.coalesce("times", F.expr("map()").cast("map<int,int>")))
    start = F.struct(F.col("times").alias("times"), F.array().cast("array<struct<mask:int,value:int>>").alias("kept"))

    def step(state, cube):
        spare = F.forall(cube["mins"], lambda m: state["times"][m] >= 2)
        fewer = F.transform_values(state["times"], lambda m, n: n - F.array_contains(cube["mins"], m).cast("int"))
        this = F.array_append(state["kept"], F.struct(cube["mask"].alias("mask"), cube["value"].alias("value")))
        return F.struct(F.when(spare, fewer).otherwise(state["times"]).alias("times"), F.when(spare, state["kept"]).otherwise(this).alias("kept"))

    return rows.select("fn", F.explode(F.aggregate("cubes", start, step)["kept"]).alias("x")).select("fn", "x.mask", "x.value")


def prune_redundant(cubes: DataFrame, dc: DataFrame, bits: int) -> DataFrame:
    """A cover without the cubes that others and don't-cares make redundant, in the order of mask and value."""
    cubes = distinct_cubes(cubes)
    every = cubes.select("fn").distinct().withColumn("minterm", F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))))
    need = chart(cubes, every).select("fn", "minterm").distinct().join(dc.select("fn", "minterm"), ["fn", "minterm"], "left_anti")
    return prune_in_order(cubes.withColumn("place", F.struct("mask", "value")), need)


def minimise(on: DataFrame, dc: DataFrame, bits: int, objectives=("literals",)) -> DataFrame:
    """``fn, objective, mask, value``: a cover of each function for each objective.

    Primes of on- and don't-care minterms, chosen greedily by the objective's weights, swept for
    superfluous cubes in the order of choice.  A function without on-minterms has no rows."""
    on, dc = canonical(on, dc)
    on = keep(on, "on")
    pool = keep(useful(primes(on.union(dc), bits), on), "pool")
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("objective"), cube_weight(F.col("mask"), o).alias("weight")) for o in objectives]))
    keyed = pool.select("fn", "mask", "value", each.alias("o")).select(F.struct("fn", "o.objective").alias("fn"), "mask", "value", "o.weight")
    wanted = keyed.select(F.col("fn").alias("key")).distinct().join(on, F.col("key")["fn"] == on["fn"]).select(F.col("key").alias("fn"), "minterm")
    cover = prune_in_order(greedy_cover(keyed, wanted).withColumnRenamed("turn", "place"), wanted)
    return cover.select("fn.fn", "fn.objective", "mask", "value")


def minimum_cover(cubes: DataFrame, on: DataFrame) -> DataFrame:
    """``fn, mask, value``: a cover of fewest cubes, then fewest literals, of each function.

    The search goes level by level: a row is what is left to cover after so many cubes; it branches
    on the minterm with the fewest cubes, and of rows with the same rest only the cheapest stays.
    The first level with nothing left is the minimum.  Rows are spread over the cluster; their
    number may grow exponentially with the cubes that no minterm forces.  A minterm that no cube
    covers is an error."""
    hits = keep(_hits(distinct_cubes(cubes), on.select("fn", "minterm").distinct()), "hits")
    if on.select("fn", "minterm").join(hits, ["fn", "minterm"], "left_anti").take(1):
        raise ValueError("a minterm that no cube covers")
    few = hits.groupBy("fn", "minterm").agg(F.count("*").alias("n"))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("fn").orderBy("n", "minterm")))
    ranked = hits.join(few, ["fn", "minterm"]).select("fn", "mask", "value", "rank")
    own = ranked.groupBy("fn", "mask", "value").agg(F.collect_list("rank").alias("mins"))
    options = keep(ranked.join(own, ["fn", "mask", "value"]).select("fn", "rank", "mask", "value", "mins"), "options")
    taken = F.array().cast("array<struct<mask:int,value:int>>")
    state = few.groupBy("fn").agg(F.array_sort(F.collect_list("rank")).alias("left")).select("fn", "left", F.lit(0).alias("literals"), taken.alias("taken"))
    found = []
    while True:
        state = keep(state, "level")
        whole = state.where(F.size("left") == 0)
        best = keep(whole.groupBy("fn").agg(F.min(F.struct("literals", "taken")).alias("x")), "cover")
        found.append(best.select("fn", F.explode("x.taken").alias("c")).select("fn", "c.mask", "c.value"))
        state = state.join(best.select("fn"), "fn", "left_anti")
        if not state.take(1):
            break
        more = state.withColumn("rank", F.get("left", F.lit(0))).join(options, ["fn", "rank"])
        more = more.select("fn", F.array_except("left", "mins").alias("left"), (F.col("literals") + popcount(F.col("mask"))).alias("literals"), F.array_append("taken", F.struct("mask", "value")).alias("taken"))
        state = more.groupBy("fn", "left").agg(F.min(F.struct("literals", "taken")).alias("x")).select("fn", "left", "x.literals", "x.taken")
    return reduce(DataFrame.union, found)


def gate_counts(cubes: DataFrame, bits: int) -> DataFrame:
    """Nodes of the shared two-level network of each cover: pins, inverters, ANDs of two or
    more inputs, the final OR."""
    c = distinct_cubes(cubes)
    return c.groupBy("fn").agg(
        F.lit(bits).cast("long").alias("pins"), popcount(F.bit_or(F.col("mask").bitwiseAND(F.bitwise_not("value")))).cast("long").alias("nots"),
        F.count_if(popcount(F.col("mask")) > 1).alias("ands"), (F.count("*") > 1).cast("long").alias("ors"),
    )


def column_of(cubes: list[tuple[int, int]], bits: list):
    """A cover as one Boolean column over named bit columns: OR of ANDs, no Python at run time."""
    out = F.lit(False)
    for mask, value in sorted(cubes):
        term = F.lit(True)
        for i, bit in enumerate(bits):
            if mask >> i & 1:
                term = term & (bit if value >> i & 1 else ~bit)
        out = out | term
    return out
