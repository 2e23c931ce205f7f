"""Boolean queries: which combinations of row attributes stand out, and in how few literals.

A function per return flag of ``lineitem``: six yes/no attributes make 64 minterms;
a combination is on if it holds more than 1/64 of the flag's rows, don't-care if no
row has it.
"""

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators import boolean as B
from bitloom.functions.bits import float_bits
from bitloom.sources.tables import keep, table

BITS = 6
ATTRIBUTES = ("l_quantity >= 25", "l_discount >= 0.05", "l_tax >= 0.04", "l_linestatus = 'F'", "l_linenumber >= 4", "l_extendedprice >= 50000")


def coded(spark, sf) -> DataFrame:
    code = " + ".join(f"CASE WHEN {a} THEN {1 << i} ELSE 0 END" for i, a in enumerate(ATTRIBUTES))
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fn"), F.expr(code).cast("int").alias("minterm"), "l_quantity")


def truth(spark, sf) -> DataFrame:
    """``fn, minterm, out, dc`` for all 64 minterms of each function."""
    cells = coded(spark, sf).groupBy("fn", "minterm").agg(F.count("*").alias("n"))
    totals = cells.groupBy("fn").agg(F.sum("n").alias("total"))
    grid = totals.withColumn("minterm", F.explode(F.sequence(F.lit(0), F.lit((1 << BITS) - 1))))
    return grid.join(cells, ["fn", "minterm"], "left").select("fn", "minterm", F.coalesce(F.col("n") * 64 > F.col("total"), F.lit(False)).cast("int").alias("out"), F.col("n").isNull().alias("dc"))


def _sets(spark, sf):
    """On, don't-care and allowed sets, from one table of states."""
    st = keep(B.states(truth(spark, sf)), "states")
    of = lambda *names: st.where(F.col("state").isin(*names)).select("fn", "minterm")
    return of("ON"), of("DC"), of("ON", "DC")


def _primes(spark, sf):
    on, dc, allowed = _sets(spark, sf)
    return on, dc, allowed, keep(B.primes(allowed, BITS), "primes")


def states(spark, sf):
    return B.states(truth(spark, sf))


def canonical(spark, sf):
    cells = coded(spark, sf)
    on, dc = B.canonical(cells.where("l_quantity >= 25"), cells.where("l_quantity < 30"))
    return on.withColumn("state", F.lit("ON")).union(dc.withColumn("state", F.lit("DC")))


def implicants(spark, sf):
    return B.implicants(_sets(spark, sf)[2], BITS)


def cube_implicants(spark, sf):
    return B.cube_implicants(_sets(spark, sf)[2], BITS)


def primes(spark, sf):
    return B.primes(_sets(spark, sf)[2], BITS).withColumn("literals", F.bit_count("mask"))


def useful(spark, sf):
    on, _, _, p = _primes(spark, sf)
    return B.useful(p, on)


def chart(spark, sf):
    on, _, _, p = _primes(spark, sf)
    return B.chart(p, on)


def essential(spark, sf):
    on, _, _, p = _primes(spark, sf)
    return B.essential(p, on)


def guarded(spark, sf):
    """Observed combinations without their last two attributes: which shorter cubes stay legal?"""
    _, _, allowed = _sets(spark, sf)
    cubes = allowed.select("fn", F.lit(15).alias("mask"), F.col("minterm").bitwiseAND(15).alias("value")).distinct()
    return B.guarded(cubes, allowed, BITS)


def absorbed(spark, sf):
    return B.absorb(B.implicants(_sets(spark, sf)[2], BITS))


def consensus(spark, sf):
    _, _, allowed = _sets(spark, sf)
    return B.consensus(allowed.select("fn", F.lit(63).alias("mask"), F.col("minterm").alias("value")), allowed, BITS)


def redundant(spark, sf):
    """Of all implicants, those that others and don't-cares make redundant."""
    _, dc, allowed = _sets(spark, sf)
    return B.redundant(keep(B.cube_implicants(allowed, BITS), "implicants"), dc, BITS)


def irredundant(spark, sf):
    """Of all implicants, those each of whose on-minterms another one covers too."""
    on, _, allowed = _sets(spark, sf)
    return B.irredundant_step(keep(B.cube_implicants(allowed, BITS), "implicants"), on)


def pruned(spark, sf):
    """Primes that stay when redundant ones go one by one, smallest mask and value first."""
    _, dc, _, p = _primes(spark, sf)
    return B.prune_redundant(p, dc, BITS)


def by_objective(spark, sf):
    on, dc, _ = _sets(spark, sf)
    return B.minimise(on, dc, BITS, B.OBJECTIVES)


def weights(spark, sf):
    _, _, _, p = _primes(spark, sf)
    return p.select("fn", "mask", "value", *[B.cube_weight(F.col("mask"), o).cast("double").alias(o) for o in B.OBJECTIVES])


def costs(spark, sf):
    on, _, _, p = _primes(spark, sf)
    return B.cover_costs(B.useful(p, on))


def better(spark, sf):
    """Minterms as they are, or the useful primes: the cheaper cover of each function by gate area."""
    on, _, _, p = _primes(spark, sf)
    raw = B.cover_costs(on.select("fn", F.lit(63).alias("mask"), F.col("minterm").alias("value"))).withColumn("cover", F.lit("minterms"))
    short = B.cover_costs(B.useful(p, on)).withColumn("cover", F.lit("primes"))
    return B.better(raw.union(short), "area").select("fn", "cover", "terms", "literals", "area")


def _compiled(cover: DataFrame, bits: list):
    """One condition over ``fn`` and bit columns for a cover of some dozens of cubes."""
    by_fn: dict = {}
    for r in cover.collect():  # the text of the condition, not data
        by_fn.setdefault(r["fn"], []).append((r["mask"], r["value"]))
    said = F.lit(False)
    for fn, cubes in sorted(by_fn.items()):
        said = said | ((F.col("fn") == fn) & B.column_of(cubes, bits))
    return said


def greedy(spark, sf):
    """The compiled cover of each function as a filter over ``lineitem``: rows and quantity it selects."""
    on, dc, _ = _sets(spark, sf)
    rows = table(spark, sf, "lineitem").withColumn("fn", F.col("l_returnflag"))
    said = _compiled(B.minimise(on, dc, BITS), [F.expr(a) for a in ATTRIBUTES])
    return rows.where(said).groupBy("fn").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def cover_table(spark, sf):
    """Two covers against the whole table, don't-cares included: how many minterms differ, and the first."""
    on, _, _, p = _primes(spark, sf)
    covers = B.essential(p, on).withColumn("cover", F.lit("essential")).union(B.useful(p, on).withColumn("cover", F.lit("useful")))
    keyed = covers.select(F.concat_ws("|", "cover", "fn").alias("fn"), "mask", "value")
    st = B.states(truth(spark, sf)).withColumn("cover", F.explode(F.array(F.lit("essential"), F.lit("useful"))))
    st = st.withColumn("key", F.concat_ws("|", "cover", "fn"))
    hit = B.chart(keyed, st.select(F.col("key").alias("fn"), "minterm")).select(F.col("fn").alias("key"), "minterm").distinct().withColumn("said", F.lit(True))
    both = st.join(hit, ["key", "minterm"], "left")
    wrong = F.coalesce("said", F.lit(False)) != (F.col("state") == "ON")
    return both.groupBy("fn", "cover").agg(F.count("*").alias("checked"), F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, F.col("minterm"))).alias("first_wrong"))


def minimum(spark, sf):
    on, _, _, p = _primes(spark, sf)
    return B.minimum_cover(p, on).groupBy("fn").agg(F.count("*").alias("terms"), F.sum(F.bit_count("mask")).cast("long").alias("literals"))


def gates(spark, sf):
    on, _, _, p = _primes(spark, sf)
    return B.gate_counts(B.useful(p, on), BITS)


def table_again(spark, sf):
    """All 64 minterms of each function as the compiled useful primes state them."""
    on, _, _, p = _primes(spark, sf)
    rows = coded(spark, sf).select("fn").distinct().withColumn("minterm", F.explode(F.sequence(F.lit(0), F.lit((1 << BITS) - 1))))
    return rows.withColumn("value", _compiled(B.useful(p, on), [F.expr(f"(minterm >> {i}) & 1 = 1") for i in range(BITS)]))


def bit_strings(spark, sf):
    """Sizes of parts as bits, low bit first."""
    return table(spark, sf, "part").select("p_partkey", F.reverse(F.bin("p_size")).alias("bits"))


def price_bits(spark, sf):
    """Prices of parts in single precision as bits, sign first."""
    return table(spark, sf, "part").select("p_partkey", float_bits(F.col("p_retailprice").cast("float")).alias("bits"))


@cache
def _prefix() -> str:
    code = " + ".join(f"CASE WHEN {a} THEN {1 << i} ELSE 0 END" for i, a in enumerate(ATTRIBUTES))
    return f"""
WITH coded AS (SELECT l_returnflag AS fn, CAST({code} AS INTEGER) AS minterm, l_quantity FROM lineitem),
cells AS (SELECT fn, minterm, count(*) AS n FROM coded GROUP BY ALL),
totals AS (SELECT fn, sum(n) AS total FROM cells GROUP BY fn),
grid AS (SELECT fn, total, CAST(r.i AS INTEGER) AS minterm FROM totals, range(64) r(i)),
truth AS (SELECT g.fn, g.minterm, coalesce(n * 64 > total, FALSE) AS is_on, n IS NULL AS dc
          FROM grid g LEFT JOIN cells c ON g.fn = c.fn AND g.minterm = c.minterm),
state AS (SELECT fn, minterm, CASE WHEN dc THEN 'DC' WHEN is_on THEN 'ON' ELSE 'OFF' END AS state FROM truth),
allowed AS (SELECT fn, minterm FROM state WHERE state <> 'OFF'),
ons AS (SELECT fn, minterm FROM state WHERE state = 'ON'),
every AS (SELECT CAST(m.i AS INTEGER) AS mask, CAST(v.i AS INTEGER) AS value FROM range(64) m(i), range(64) v(i) WHERE (v.i & (63 - m.i)) = 0),
imp AS (SELECT a.fn, e.mask, e.value FROM every e JOIN allowed a ON (a.minterm & e.mask) = e.value
        GROUP BY ALL HAVING count(*) = (1 << (6 - bit_count(e.mask)))),
prime AS (SELECT * FROM imp a WHERE NOT EXISTS (SELECT 1 FROM imp b WHERE b.fn = a.fn AND b.mask <> a.mask
          AND (b.mask & a.mask) = b.mask AND (a.value & b.mask) = b.value)),
chart AS (SELECT p.fn, p.mask, p.value, o.minterm FROM prime p JOIN ons o ON o.fn = p.fn AND (o.minterm & p.mask) = p.value),
used AS (SELECT DISTINCT fn, mask, value FROM chart)"""


def _cost_sql(source: str) -> str:
    return f"""
lits AS (SELECT fn, mask, value, bit_count(mask) AS l FROM {source}),
sums AS (SELECT fn, count(*) AS terms, CAST(sum(l) AS BIGINT) AS literals, CAST(bit_count(bit_or(mask & (63 - value))) AS BIGINT) AS inverters,
         CAST(sum(greatest(l - 1, 0)) + CASE WHEN count(*) > 1 THEN count(*) - 1 ELSE 0 END AS BIGINT) AS gates,
         CAST(max(CASE WHEN l <= 1 THEN 0 WHEN l <= 2 THEN 1 WHEN l <= 4 THEN 2 ELSE 3 END + 1)
              + CASE WHEN count(*) > 1 THEN ceil(log2(count(*))) ELSE 0 END AS BIGINT) AS levels,
         CAST(sum(ceil(greatest(l, 1) / 4.0)) + CASE WHEN count(*) > 1 THEN ceil(count(*) / 4.0) ELSE 0 END AS BIGINT) AS luts4,
         CAST(sum(ceil(greatest(l, 1) / 6.0)) + CASE WHEN count(*) > 1 THEN ceil(count(*) / 6.0) ELSE 0 END AS BIGINT) AS luts6
         FROM lits GROUP BY fn),
costed AS (SELECT *, gates + inverters * 0.2::DOUBLE AS area, levels + gates * 0.01::DOUBLE AS delay,
           luts4 + levels * 0.05::DOUBLE AS cost4, luts6 + levels * 0.05::DOUBLE AS cost6 FROM sums)"""


def _greedy_sql(p: str) -> str:
    """Greedy choice by merit for each objective, then a sweep in the order of choice, as recursions over bit sets."""
    weights = (
        "SELECT mask, 'literals' AS objective, greatest(bit_count(mask), 1)::DOUBLE AS w FROM m UNION ALL SELECT mask, 'area', greatest(bit_count(mask), 1) + 0.8::DOUBLE FROM m"
        " UNION ALL SELECT mask, 'delay', (CASE WHEN bit_count(mask) <= 1 THEN 1 WHEN bit_count(mask) <= 2 THEN 2 WHEN bit_count(mask) <= 4 THEN 3 ELSE 4 END)::DOUBLE FROM m"
        " UNION ALL SELECT mask, 'lut4', ceil(greatest(bit_count(mask), 1) / 4.0)::DOUBLE FROM m UNION ALL SELECT mask, 'lut6', ceil(greatest(bit_count(mask), 1) / 6.0)::DOUBLE FROM m"
    )
    return (
        "WITH RECURSIVE" + p.replace("\nWITH", "", 1)
        + f", m AS (SELECT DISTINCT mask FROM used), weight AS ({weights}),"
        " pool AS (SELECT fn, mask, value, bit_or(1::HUGEINT << minterm) AS bits FROM chart GROUP BY ALL),"
        " goal AS (SELECT fn, bit_or(1::HUGEINT << minterm) AS want FROM ons GROUP BY fn),"
        " pick AS (SELECT objective, fn, 0 AS turn, want AS rest, CAST(NULL AS INTEGER) AS mask, CAST(NULL AS INTEGER) AS value, 0::HUGEINT AS bits FROM goal, (SELECT DISTINCT objective FROM weight)"
        " UNION ALL SELECT g.objective, g.fn, g.turn + 1, g.rest - (g.rest & q.bits), q.mask, q.value, q.bits"
        " FROM pick g JOIN pool q ON q.fn = g.fn JOIN weight w ON w.mask = q.mask AND w.objective = g.objective WHERE (g.rest & q.bits) <> 0"
        " QUALIFY row_number() OVER (PARTITION BY g.objective, g.fn ORDER BY bit_count(g.rest & q.bits) / w.w DESC, bit_count(g.rest & q.bits) DESC, q.mask, q.value) = 1),"
        " chosen AS (SELECT objective, fn, turn, mask, value, bits, max(turn) OVER (PARTITION BY objective, fn) AS last FROM pick WHERE turn > 0),"
        " walk AS (SELECT DISTINCT objective, fn, 1 AS i, []::INTEGER[] AS gone FROM chosen UNION ALL"
        " SELECT w.objective, w.fn, w.i + 1, CASE WHEN min(g.want) & ~bit_or(CASE WHEN c.turn <> w.i AND NOT list_contains(w.gone, c.turn) THEN c.bits ELSE 0::HUGEINT END) = 0"
        " THEN list_append(w.gone, w.i) ELSE w.gone END FROM walk w JOIN chosen c ON c.objective = w.objective AND c.fn = w.fn JOIN goal g ON g.fn = w.fn WHERE w.i <= c.last GROUP BY w.objective, w.fn, w.i, w.gone)"
        " SELECT c.fn, c.objective, c.mask, c.value FROM chosen c JOIN walk w ON w.objective = c.objective AND w.fn = c.fn AND w.i = c.last + 1 WHERE NOT list_contains(w.gone, c.turn)"
    )


def registry() -> dict:
    p = _prefix()
    lonely = "lonely AS (SELECT fn, minterm FROM chart GROUP BY ALL HAVING count(*) = 1)"
    return {
        "over_represented": (primes, p + " SELECT fn, mask, value, CAST(bit_count(mask) AS INTEGER) AS literals FROM prime"),
        "b1_states": (states, p + " SELECT fn, minterm, state FROM state"),
        "b2_canonical_sets": (
            canonical,
            p + ", o AS (SELECT DISTINCT fn, minterm FROM coded WHERE l_quantity >= 25), d AS (SELECT DISTINCT fn, minterm FROM coded WHERE l_quantity < 30)"
            " SELECT fn, minterm, 'ON' AS state FROM o UNION ALL SELECT fn, minterm, 'DC' FROM (SELECT * FROM d EXCEPT SELECT * FROM o)",
        ),
        "b5_implicants": (implicants, p + " SELECT fn, mask, value FROM imp"),
        "b10_implicants_by_cube": (cube_implicants, p + " SELECT fn, mask, value FROM imp"),
        "b11_useful_primes": (useful, p + " SELECT fn, mask, value FROM used"),
        "b12_prime_chart": (chart, p + " SELECT fn, mask, value, minterm FROM chart"),
        "b13_essential_primes": (essential, p + f", {lonely} SELECT DISTINCT c.fn, mask, value FROM chart c JOIN lonely l ON c.fn = l.fn AND c.minterm = l.minterm"),
        "b20_legal_cubes": (
            guarded,
            p + ", q AS (SELECT DISTINCT fn, 15 AS mask, minterm & 15 AS value FROM allowed)"
            " SELECT q.fn, q.mask, q.value FROM q JOIN imp i ON q.fn = i.fn AND q.mask = i.mask AND q.value = i.value",
        ),
        "b24_superfluous_cubes": (
            irredundant,
            p + ", hit AS (SELECT i.fn, i.mask, i.value, o.minterm FROM imp i JOIN ons o ON o.fn = i.fn AND (o.minterm & i.mask) = i.value),"
            " one AS (SELECT fn, minterm FROM hit GROUP BY ALL HAVING count(*) = 1)"
            " SELECT fn, mask, value FROM imp EXCEPT SELECT h.fn, mask, value FROM hit h JOIN one l ON h.fn = l.fn AND h.minterm = l.minterm",
        ),
        "b25_absorption": (absorbed, p + " SELECT fn, mask, value FROM prime"),
        "b26_consensus": (consensus, p + " SELECT fn, mask, value FROM imp WHERE bit_count(mask) = 5"),
        "b27_cube_weights": (
            weights,
            p + " SELECT fn, mask, value, greatest(bit_count(mask), 1)::DOUBLE AS literals, greatest(bit_count(mask), 1) + 0.8::DOUBLE AS area,"
            " (CASE WHEN bit_count(mask) <= 1 THEN 1 WHEN bit_count(mask) <= 2 THEN 2 WHEN bit_count(mask) <= 4 THEN 3 ELSE 4 END)::DOUBLE AS delay,"
            " ceil(greatest(bit_count(mask), 1) / 4.0)::DOUBLE AS lut4, ceil(greatest(bit_count(mask), 1) / 6.0)::DOUBLE AS lut6 FROM prime",
        ),
        "b28_cover_costs": (costs, p + "," + _cost_sql("used") + " SELECT * FROM costed"),
        "b29_better_cover": (
            better,
            p + ", covers AS (SELECT fn, 'primes' AS cover, mask, value FROM used UNION ALL SELECT fn, 'minterms', 63, minterm FROM ons),"
            + _cost_sql("(SELECT fn || '|' || cover AS fn, mask, value FROM covers)")
            + " SELECT split_part(fn, '|', 1) AS fn, split_part(fn, '|', 2) AS cover, terms, literals, area FROM costed"
            " QUALIFY row_number() OVER (PARTITION BY split_part(fn, '|', 1) ORDER BY round(area, 9), literals, terms, split_part(fn, '|', 2)) = 1",
        ),
        "b42_redundant_terms": (
            redundant,
            p + ", cov AS (SELECT p.fn, p.mask, p.value, CAST(r.i AS INTEGER) AS minterm FROM imp p, range(64) r(i) WHERE (CAST(r.i AS INTEGER) & p.mask) = p.value),"
            " one AS (SELECT fn, minterm FROM cov GROUP BY ALL HAVING count(*) = 1), need AS (SELECT * FROM one EXCEPT SELECT fn, minterm FROM state WHERE state = 'DC')"
            " SELECT fn, mask, value FROM imp EXCEPT SELECT c.fn, mask, value FROM cov c JOIN need n ON c.fn = n.fn AND c.minterm = n.minterm",
        ),
        "b43_pruned_in_order": (
            pruned,
            "WITH RECURSIVE" + p.replace("\nWITH", "", 1)
            + ", num AS (SELECT fn, mask, value, row_number() OVER (PARTITION BY fn ORDER BY mask, value) AS i FROM prime),"
            " cov AS (SELECT n.fn, n.i, bit_or(1::HUGEINT << CAST(r.i AS INTEGER)) AS m FROM num n, range(64) r(i) WHERE (CAST(r.i AS INTEGER) & n.mask) = n.value GROUP BY n.fn, n.i),"
            " nots AS (SELECT fn, bit_or(CASE WHEN state = 'DC' THEN 1::HUGEINT << minterm ELSE 0::HUGEINT END) AS d, (SELECT max(i) FROM num z WHERE z.fn = state.fn) AS last FROM state GROUP BY fn),"
            " walk AS (SELECT fn, 1::BIGINT AS i, []::BIGINT[] AS gone FROM nots UNION ALL"
            " SELECT w.fn, w.i + 1, CASE WHEN bit_or(CASE WHEN c.i = w.i THEN c.m ELSE 0::HUGEINT END) & ~(bit_or(CASE WHEN c.i <> w.i AND NOT list_contains(w.gone, c.i) THEN c.m ELSE 0::HUGEINT END) | min(t.d)) = 0"
            " THEN list_append(w.gone, w.i) ELSE w.gone END FROM walk w JOIN cov c ON c.fn = w.fn JOIN nots t ON t.fn = w.fn WHERE w.i <= t.last GROUP BY w.fn, w.i, w.gone)"
            " SELECT n.fn, n.mask, n.value FROM num n JOIN nots t ON t.fn = n.fn JOIN walk w ON w.fn = n.fn AND w.i = t.last + 1 WHERE NOT list_contains(w.gone, n.i)",
        ),
        "m6_covers_by_objective": (by_objective, _greedy_sql(p)),
        "b7_float_bits": (price_bits, "SELECT p_partkey, CAST(CAST(CAST(p_retailprice AS FLOAT) AS BIT) AS VARCHAR) AS bits FROM part"),
        "b7_bit_strings": (bit_strings, "SELECT p_partkey, reverse(CASE WHEN p_size = 0 THEN '0' ELSE ltrim(bin(p_size), '0') END) AS bits FROM part"),
        "b14_minimum_cover": (
            minimum,
            p + ", idx AS (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY mask, value) - 1 AS i FROM used), num AS (SELECT fn, count(*) AS n FROM idx GROUP BY fn),"
            " opt AS (SELECT c.fn, c.minterm, bit_or(1::BIGINT << i) AS o FROM chart c JOIN idx USING (fn, mask, value) GROUP BY ALL),"
            " sub AS (SELECT fn, unnest(range((1::BIGINT << n))) AS s FROM num), ok AS (SELECT sub.fn, s FROM sub JOIN opt ON sub.fn = opt.fn GROUP BY ALL HAVING bool_and((o & s) <> 0)),"
            " cost AS (SELECT ok.fn, s, count(*) AS terms, CAST(sum(bit_count(mask)) AS BIGINT) AS literals FROM ok JOIN idx ON ok.fn = idx.fn AND (s >> i) & 1 = 1 GROUP BY ALL)"
            " SELECT fn, terms, literals FROM cost QUALIFY row_number() OVER (PARTITION BY fn ORDER BY terms, literals, s) = 1",
        ),
        "m8_table_of_cover": (
            table_again,
            p + " SELECT g.fn, g.minterm, bool_or(u.fn IS NOT NULL) AS value FROM grid g LEFT JOIN used u ON g.fn = u.fn AND (g.minterm & u.mask) = u.value GROUP BY ALL",
        ),
        "m10_gate_counts": (
            gates,
            p + " SELECT fn, CAST(6 AS BIGINT) AS pins, CAST(bit_count(bit_or(mask & (63 - value))) AS BIGINT) AS nots, count(*) FILTER (WHERE bit_count(mask) > 1) AS ands,"
            " CAST(count(*) > 1 AS BIGINT) AS ors FROM used GROUP BY fn",
        ),
        "m4_compiled_filter": (
            greedy,
            p + " SELECT c.fn, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM coded c JOIN ons o ON c.fn = o.fn AND c.minterm = o.minterm GROUP BY c.fn",
        ),
        "m9_cover_validated": (
            cover_table,
            p + f", {lonely}, ess AS (SELECT DISTINCT c.fn, mask, value FROM chart c JOIN lonely l ON c.fn = l.fn AND c.minterm = l.minterm),"
            " covers AS (SELECT 'essential' AS cover, * FROM ess UNION ALL SELECT 'useful', * FROM used),"
            " kinds AS (SELECT unnest(['essential', 'useful']) AS cover),"
            " said AS (SELECT s.fn, k.cover, s.minterm, s.state = 'ON' AS want, EXISTS (SELECT 1 FROM covers c WHERE c.cover = k.cover AND c.fn = s.fn AND (s.minterm & c.mask) = c.value) AS got FROM state s, kinds k)"
            " SELECT fn, cover, count(*) AS checked, count(*) FILTER (WHERE want <> got) AS wrong, min(CASE WHEN want <> got THEN minterm END) AS first_wrong FROM said GROUP BY fn, cover",
        ),
    }
