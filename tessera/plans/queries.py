"""Registered queries and the SQL that gives the same rows over the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ufuncs import BINARY, UNARY
from ..operators import BandMatrix, balance, tad
from ..operators.reductions import reduce
from .fixtures import D, N, W, events, events_coo, masked_events, parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_CELLS = f"""
ev as (select user_id, event_type, event_id, cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 21600) as int) b from events),
cells as (
  select a.event_type chrom, a.b i, b.b - a.b k, count(*)::double v from ev a join ev b on a.user_id = b.user_id and a.event_type = b.event_type
    and (a.b < b.b or (a.b = b.b and a.event_id < b.event_id)) where b.b - a.b < {D} group by all
), chroms as (select distinct chrom from cells),
plain as (
  select chrom, i::bigint i, k::bigint k, coalesce(v, 0) v from (select chrom, r.i, q.k from chroms, range({N}) r(i), range({D}) q(k) where r.i + q.k < {N}) left join cells using (chrom, i, k)
), band as (
  select chrom, i, k, v raw, (i * 7 + k * 3) % 11 = 0 as em, (i % 17 = 3 or (i + k) % 17 = 3) as bm, case when not em and not bm then v end v from plain
), dense as (
  select chroms.chrom, r.i::bigint "row", c.i::bigint col, abs(r.i - c.i) < {D} inside,
    case when r.i % 17 = 3 or c.i % 17 = 3 then null when abs(r.i - c.i) >= {D} then 0.1::double else b.v end v
  from chroms cross join range({N}) r(i) cross join range({N}) c(i) left join band b on b.chrom = chroms.chrom and b.i = least(r.i, c.i) and b.k = abs(r.i - c.i)
)
"""


def _sql(body: str) -> str:
    return f"with {_CELLS} {body}"


def _query(name: str, sql: str | None = None, raw: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if raw else _sql(sql)
        return f

    return add


def _out(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles to 6 digits, so that both engines give equal rows."""
    cols: list[Column] = []
    for c, kind in df.dtypes:
        cols.append(F.col(c).cast("long").alias(c) if kind in ("int", "bigint") else (F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c))
    return df.select(*cols)


_R = "round({0}, 6) + 0.0"


def _six(c: Column) -> Column:
    """round(c, 6) as SQL has it: the whole number next to c * 1e6 over 1e6, which for large c is not always c's nearest such decimal."""
    x = F.round(c * 1e6, 0) / 1e6
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), c).otherwise(x) + 0.0


# ---- ingest, sinks, masks ---------------------------------------------------------------------------------------


@_query("ingest_coo", "select chrom, i::bigint i, k::bigint k, v::double v from cells")
def _(spark, d):
    return _out(events(spark, d).cells.select("chrom", "i", "k", "v"))


@_query("ingest_last", f"select chrom, least(r, c)::bigint i, abs(r - c)::bigint k, arg_max(v, ord)::double v from (select event_type chrom, user_id % {N} r, event_id % {N} c, value v, event_id ord from events) where abs(r - c) < {D} group by all")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("chrom"), (F.col("user_id") % N).alias("row"), (F.col("event_id") % N).alias("col"), "value", "event_id")
    return BandMatrix.from_coo(e, D, N, how="last", order="event_id").cells.select("chrom", F.col("i").cast("long").alias("i"), F.col("k").cast("long").alias("k"), "v")


@_query("ingest_dense", "select chrom, i, k, v from plain where v <> 0")
def _(spark, d):
    rows = events(spark, d).full_rows()
    return _out(BandMatrix.from_dense(rows, D).cells.where("v <> 0").select("chrom", "i", "k", "v"))


@_query("ingest_band", "select chrom, i, k, v from plain where v <> 0")
def _(spark, d):
    return _out(BandMatrix.from_band(events(spark, d).toarray()).cells.where("v <> 0").select("chrom", "i", "k", "v"))


@_query("factories", "select 'eye' what, 6.0::double total, 6.0::double diagonal union all select 'full', 75.0, 15.0 union all select 'ones', 36.0, 6.0 union all select 'zeros', 0.0, 0.0 union all select 'eye_like', 6.0, 6.0 union all select 'full_like', 108.0, 18.0", raw=True)
def _(spark, d):
    s = {"c": 6}
    made = {"eye": BandMatrix.eye(spark, s, 3), "ones": BandMatrix.ones(spark, s, 3), "zeros": BandMatrix.zeros(spark, s, 3), "full": BandMatrix.full(spark, {"c": 5}, 2, 3.0)}
    made |= {"eye_like": made["ones"].eye_like(), "full_like": made["ones"].full_like(3.0)}
    out = None
    for name, m in made.items():
        one = reduce(m, "sum").select(F.lit(name).alias("what"), F.col("value").alias("total")).crossJoin(reduce(m, "sum", "diag").where("k = 0").select(F.col("value").alias("diagonal")))
        out = one if out is None else out.union(one)
    return out


@_query("mask_cells", "select chrom, i, k from band where v is null")
def _(spark, d):
    return _out(masked_events(spark, d).get_mask())


@_query("unmask", "select chrom, i, k from band where em and not (i % 2 = 0)")
def _(spark, d):
    m = masked_events(spark, d)
    at = m.rows().where("i % 2 = 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(D - 1)))).select("chrom", F.col("i").alias("row"), (F.col("i") + F.col("k")).alias("col"))
    return _out(m.unmask(at).drop_mask_bins().get_mask())


@_query("drop_mask", "select chrom, i, k from band where bm")
def _(spark, d):
    return _out(masked_events(spark, d).drop_mask().get_mask())


@_query("clear_mask", "select chrom, count(*)::bigint n from plain group by 1")
def _(spark, d):
    return masked_events(spark, d).clear_mask().band().where("v is not null").groupBy("chrom").agg(F.count("*").alias("n"))


@_query("count_masked", "select chrom, count(*) filter (v is null) masked, count(v) unmasked, count(*) filter (inside and v is null) in_band_masked, count(*) filter (not inside and v is null) out_band_masked, count(*) filter (inside) in_band, count(*) filter (not inside) out_band from dense group by 1")
def _(spark, d):
    return _out(masked_events(spark, d).counts())


@_query("filled", f"""select chrom, "row", col, {_R.format("coalesce(v, 9.5)") } "value" from (select chrom, "row", col, case when not inside then 9.5 else v end v from dense)""")
def _(spark, d):
    return _out(masked_events(spark, d).filled(9.5).todense())


@_query("tocoo", """select chrom, i "row", i + k col, v "value" from band where v <> 0""")
def _(spark, d):
    return _out(masked_events(spark, d).tocoo())


@_query("tocoo_all", """select chrom, i "row", i + k col, v "value" from band where v is not null""")
def _(spark, d):
    return _out(masked_events(spark, d).tocoo(False))


@_query("tocsr", """select chrom, i "row", count(*)::bigint n, sum((i + k) * v) weighted, list(i + k order by k)[1]::bigint first_col from band where v is not null group by all""")
def _(spark, d):
    c = masked_events(spark, d).tocsr()
    weighted = F.aggregate(F.zip_with("cols", "data", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return _out(c.select("chrom", "row", F.size("cols").alias("n"), weighted.alias("weighted"), F.element_at("cols", 1).alias("first_col")))


@_query("todense", """select chrom, "row", col, v "value" from dense""")
def _(spark, d):
    return _out(masked_events(spark, d).todense())


@_query("equality", "select chrom, true same, false other from chroms")
def _(spark, d):
    m = masked_events(spark, d)
    same = m.equals(m._with(m.cells)).select("chrom", F.col("equal").alias("same"))
    return same.join(m.equals(m.clip(0.0, 2.0)).select("chrom", F.col("equal").alias("other")), "chrom")


@_query("memory_usage", f"select chrom, {N * D * 8}::bigint bytes from chroms")
def _(spark, d):
    return _out(events(spark, d).memory_usage())


# ---- reads and writes -------------------------------------------------------------------------------------------


@_query("slice_square", """select chrom, "row" - 10 as "row", col - 10 col, v "value" from dense where "row" between 10 and 39 and col between 10 and 39""")
def _(spark, d):
    return _out(masked_events(spark, d).submatrix(10, 40).todense())


@_query("slice_rect", """select chrom, "row", col, v "value" from dense where "row" between 5 and 29 and "row" % 3 = 2 and col between 0 and 99 and col % 7 = 0""")
def _(spark, d):
    return _out(masked_events(spark, d).rectangle(range(5, 30, 3), range(0, 100, 7)))


@_query("get_values", f"""select e.event_id, d.chrom, d."row", d.col, d.v "value" from (select event_id, event_type, user_id % {N} r, event_id % {N} c from events) e join dense d on d.chrom = e.event_type and d."row" = e.r and d.col = e.c""")
def _(spark, d):
    at = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("chrom"), (F.col("user_id") % N).alias("row"), (F.col("event_id") % N).alias("col"))
    return _out(masked_events(spark, d).get_values(at))


@_query("where_bool", "select chrom, i, k, v from band where v > 2")
def _(spark, d):
    m = masked_events(spark, d)
    return _out(m.where((m > 2.0).band().where("v = 1")))


@_query("diag_k", """select chrom, i, v "value" from band where k = 7""")
def _(spark, d):
    return _out(masked_events(spark, d).diag(7))


@_query("extract_row", """select chrom, col, v "value" from dense where "row" = 50""")
def _(spark, d):
    return _out(masked_events(spark, d).extract_row(50))


@_query("extract_row_band", """select chrom, col, v "value" from dense where "row" = 50 and inside""")
def _(spark, d):
    return _out(masked_events(spark, d).extract_row(50, False))


@_query("diagonals", "select chrom, k, count(*)::bigint n, count(v)::bigint unmasked, sum(i * v) weighted from band group by all")
def _(spark, d):
    x = masked_events(spark, d).diagonals()
    weighted = F.aggregate(F.transform("values", lambda v, i: F.coalesce(v * i, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return _out(x.select("chrom", "k", F.size("values").alias("n"), F.size(F.filter("values", lambda v: v.isNotNull())).alias("unmasked"), weighted.alias("weighted")))


@_query("iterrows", f"""select chrom, "row" i, count(*)::bigint n, {_R.format("sum(col * coalesce(v, 0))")} weighted from dense group by all""")
def _(spark, d):
    x = masked_events(spark, d).full_rows()
    weighted = F.aggregate(F.transform("values", lambda v, i: F.coalesce(v * i, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return _out(x.select("chrom", "i", F.size("values").alias("n"), weighted.alias("weighted")))


@_query("iterwindows", f"select chrom, s.s::bigint start, count(*)::bigint n, coalesce(sum(v), 0) total from range(0, {N - 8 + 1}, 4) s(s), band where i >= s.s and i + k < s.s + 8 group by all")
def _(spark, d):
    return _out(masked_events(spark, d).windows(8, 4).groupBy("chrom", "start").agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total")))


@_query("contains", "select chrom, bool_or(coalesce(v = 3, false)) three, bool_or(coalesce(v = 0.1, false)) default_value, false never from dense group by 1")
def _(spark, d):
    m = masked_events(spark, d)
    out = m.contains(3.0).withColumnRenamed("found", "three").join(m.contains(0.1).withColumnRenamed("found", "default_value"), "chrom")
    return out.join(m.contains(-7.0).withColumnRenamed("found", "never"), "chrom")


@_query("set_values", f"""select chrom, i, k, case when not em and not bm then coalesce(n.v, raw) end v from band left join (select event_type chrom, least(r, c) i, abs(r - c) k, max(v) v from (select event_type, user_id % {N} r, event_id % {N} c, round(value, 2) v from events) group by all) n using (chrom, i, k)""")
def _(spark, d):
    at = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("chrom"), (F.col("user_id") % N).alias("row"), (F.col("event_id") % N).alias("col"), F.round("value", 2).alias("value"))
    return _out(masked_events(spark, d).set_values(at).band().select("chrom", "i", "k", "v"))


@_query("set_diag", "select chrom, i, k, case when k = 4 and v is not null then 2.5 else v end v from band")
def _(spark, d):
    return _out(masked_events(spark, d).set_diag(4, 2.5).band().select("chrom", "i", "k", "v"))


@_query("clip", """select chrom, "row", col, case when v is not null then least(greatest(v, 0.5), 3) end "value" from dense""")
def _(spark, d):
    return _out(masked_events(spark, d).clip(0.5, 3.0).todense())


@_query("astype", f"""select chrom, "row", col, {_R.format("trunc(v * 1.3)")} "value" from dense""")
def _(spark, d):
    return _out((masked_events(spark, d) * 1.3).astype("long").todense())


@_query("normalize_diag", f"""select chrom, i, k, {_R.format("case when v is null then null when stddev_pop(v) over w < 1e-12 then 0 else (v - avg(v) over w) / stddev_pop(v) over w end")} v from band window w as (partition by chrom, k)""")
def _(spark, d):
    return _out(masked_events(spark, d).normalize().band().select("chrom", "i", "k", "v"))


# ---- reductions -------------------------------------------------------------------------------------------------

_SQL_VALUE = {
    "sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "ptp": "max(v) - min(v)", "var": "var_pop(v)", "std": "stddev_pop(v)",
    "prod": "sum(log10(v * 0.01 + 1.001))", "all": "bool_and(v <> 0)", "any": "bool_or(v <> 0)",
}


def _reduction(name: str, axis: str | None) -> None:
    where = {None: ("all", "chrom", "dense"), "row": ("row", 'chrom, "row" i', "dense"), "diag": ("diag", "chrom, k", "band")}[axis]
    value = _SQL_VALUE[name]
    value = f"{value}" if name in ("all", "any") else _R.format(value)

    @_query(f"{name}_{where[0]}", f'select {where[1]}, {value} "value" from {where[2]} group by all')
    def _(spark, d):
        m = masked_events(spark, d)
        if name == "prod":  # as a logarithm: the product itself is beyond the range of doubles on large tables
            return _out(reduce(m * 0.01 + 1.001, "log10_prod", axis))
        return _out(reduce(m, name, axis))


for _name in _SQL_VALUE:
    for _axis in (None, "row", "diag"):
        _reduction(_name, _axis)


@_query("any_row_banded", """select chrom, "row" i, bool_or(v <> 0) "value" from dense where inside group by all""")
def _(spark, d):
    return _out(reduce(masked_events(spark, d), "any", "row", banded_only=True))


@_query("all_banded", """select chrom, bool_and(v <> 0) "value" from dense where inside group by all""")
def _(spark, d):
    return _out(reduce(masked_events(spark, d), "all", None, banded_only=True))


# ---- element-wise functions -------------------------------------------------------------------------------------

#: Functions by NumPy's name in SQL over a and b, where it is not the SQL name of one argument.
_SQL_UNARY = {
    "negative": "-a", "positive": "a", "absolute": "abs(a)", "fabs": "abs(a)", "rint": "round_even(a, 0)", "sign": "sign(a)::double", "conj": "a", "conjugate": "a", "exp2": "pow(2, a)",
    "log": "ln(a)", "expm1": "exp(a) - 1", "log1p": "ln(1 + a)", "square": "a * a", "reciprocal": "1.0 / a", "arcsin": "asin(a)", "arccos": "acos(a)", "arctan": "atan(a)",
    "arcsinh": "asinh(a)", "arccosh": "acosh(a)", "arctanh": "atanh(a)", "rad2deg": "degrees(a)", "deg2rad": "radians(a)", "invert": "(~i)", "logical_not": "a = 0",
}
_SQL_BINARY = {
    "add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": "a / b", "true_divide": "a / b", "logaddexp": "ln(exp(a) + exp(b))", "logaddexp2": "log2(pow(2, a) + pow(2, b))",
    "floor_divide": "floor(a / b)", "power": "pow(a, b)", "float_power": "pow(a, b)", "remainder": "a - floor(a / b) * b", "mod": "a - floor(a / b) * b", "fmod": "a % b", "heaviside": "case when a < 0 then 0 when a > 0 then 1 else b end",
    "gcd": "gcd(i, j)", "lcm": "lcm(i, j)", "arctan2": "atan2(a, b)", "hypot": "sqrt(a * a + b * b)", "bitwise_and": "i & j", "bitwise_or": "i | j", "bitwise_xor": "xor(i, j)",
    "left_shift": "(i * pow(2, abs(j)))::bigint", "right_shift": "floor(i / pow(2, abs(j)))::bigint", "greater": "a > b", "greater_equal": "a >= b", "less": "a < b", "less_equal": "a <= b", "not_equal": "a <> b", "equal": "a = b",
    "logical_and": "a <> 0 and b <> 0", "logical_or": "a <> 0 or b <> 0", "logical_xor": "(a <> 0) <> (b <> 0)", "maximum": "greatest(a, b)", "minimum": "least(a, b)",
}
_BOOLEAN = {"logical_not", "greater", "greater_equal", "less", "less_equal", "not_equal", "equal", "logical_and", "logical_or", "logical_xor"}
_LONG = {"invert", "gcd", "lcm", "bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift"}
#: Arguments inside the domain of each function; borders of domains are tested against NumPy.
_INSIDE = {"arcsin": "a / 8", "arccos": "a / 8", "arctanh": "a / 8.5", "arccosh": "abs(a) + 1", "log": "abs(a) + 0.5", "log2": "abs(a) + 0.5", "log10": "abs(a) + 0.5", "log1p": "abs(a)", "sqrt": "abs(a)", "reciprocal": "abs(a) + 0.5", "power": "abs(a)", "float_power": "abs(a)"}
_GROUPS = {
    "uf_arithmetic": [*(x for x in BINARY if x not in _BOOLEAN | _LONG)],
    "uf_compare": [*(x for x in BINARY if x in _BOOLEAN), "logical_not"],
    "uf_bitwise": [*(x for x in BINARY if x in _LONG), "invert"],
    "uf_unary": [x for x in UNARY if x not in _BOOLEAN | _LONG],
}
_AB = f"(select chrom, i pi, k pk, v - 3.5 a, (i * 7 + k * 3) % 13 - 6.5 b, v::bigint - 3 i, ((i * 7 + k * 3) % 13)::bigint - 6 j from plain)"


def _group(name: str, names: list[str]) -> None:
    cols = []
    for x in names:
        body = _SQL_UNARY.get(x, f"{x}(a)") if x in UNARY else _SQL_BINARY[x]
        if x in _INSIDE:
            body = re.sub(r"\ba\b", f"({_INSIDE[x]})", body)
        cols.append(f'{body if x in _BOOLEAN | _LONG else _R.format(f"({body})::double")} "{x}"')

    @_query(name, f"select chrom, pi i, pk k, {', '.join(cols)} from {_AB}")
    def _(spark, d):
        p = events(spark, d).band()
        a, b = F.col("v") - 3.5, (F.col("i") * 7 + F.col("k") * 3) % 13 - 6.5
        i, j = F.col("v").cast("long") - 3, ((F.col("i") * 7 + F.col("k") * 3) % 13).cast("long") - 6
        p = p.select("chrom", F.col("i").cast("long").alias("i"), F.col("k").cast("long").alias("k"), a.alias("a"), b.cast("double").alias("b"), i.alias("x"), j.alias("y"))
        out = []
        for x in names:
            left, right = (F.col("x"), F.col("y")) if x in _LONG else (F.expr(_INSIDE.get(x, "a")).cast("double"), F.col("b"))
            if x in ("left_shift", "right_shift"):
                right = F.abs(right)
            e = UNARY[x](left) if x in UNARY else BINARY[x](left, right)
            out.append(e.alias(x) if x in _BOOLEAN else e.cast("long").alias(x) if x in _LONG else _six(e.cast("double")).alias(x))
        return p.select("chrom", "i", "k", *out)


for _name, _names in _GROUPS.items():
    _group(_name, _names)


@_query("uf_matrices", f"""select chrom, "row", col, {_R.format("d.v + d.v * 2 + 1")} "value" from dense d""")
def _(spark, d):
    m = masked_events(spark, d)
    return _out((m + (m * 2.0 + 1.0)).todense())


# ---- analyses ---------------------------------------------------------------------------------------------------

_SIDE = f"select chrom, i, k, v from plain where k < {2 * W}"


@_query("diag_mean", "select chrom, k, round(avg(v), 6) + 0.0 mean_contact from plain group by all")
def decay(spark, d):
    """Contact decay by distance: the mean of each diagonal, unstored cells included by count."""
    return _out(reduce(events(spark, d), "mean", "diag").withColumnRenamed("value", "mean_contact"))


@_query("diamond_mean", f"select c.chrom, b.b::bigint i, {_R.format(f'case when b.b = {N - 1} then 0 else avg(p.v) end')} mean_cf from chroms c cross join range({N}) b(b) left join plain p on p.chrom = c.chrom and p.i between b.b - {W} + 1 and b.b and p.i + p.k between b.b + 1 and b.b + {W} group by c.chrom, b.b")
def _(spark, d):
    return _out(tad.diamond_mean(events(spark, d), W))


_SPARSE = "select chrom, i, k, case when (i * 5 + k) % 4 = 0 and i % 9 <> 0 and (i + k) % 9 <> 0 then v else 0 end v from plain"


def _thin(spark: SparkSession, d: str) -> BandMatrix:
    """With empty bins."""
    m = events(spark, d)
    keep = ((F.col("i") * 5 + F.col("k")) % 4 == 0) & (F.col("i") % 9 != 0) & ((F.col("i") + F.col("k")) % 9 != 0)
    return m._with(m.cells.where(keep))


_GAPS = f"select chrom, r.r i from chroms, range({N}) r(r) where 0 = (select coalesce(sum(t.v), 0) from thin t where t.chrom = chroms.chrom and ((t.i = r.r and t.k <= {W} - 1) or (t.i + t.k = r.r and t.k between 1 and {W})))"


@_query("gap_bins", f"select chrom, i::bigint i from (with thin as ({_SPARSE}) {_GAPS})")
def _(spark, d):
    return _out(tad.gap_bins(_thin(spark, d), W))


@_query("regions", f"""select chrom, min(i)::bigint start, max(i)::bigint + 1 "end" from (
  select chrom, i, i - row_number() over (partition by chrom order by i) g from (
    select chrom, r.i from chroms, range({N}) r(i) except (with thin as ({_SPARSE}) {_GAPS}))) group by chrom, g having max(i) + 1 - min(i) > 3""")
def _(spark, d):
    m = _thin(spark, d)
    free = m.rows().select("chrom", "i").join(tad.gap_bins(m, W), ["chrom", "i"], "left_anti")
    return _out(tad.runs(free, 3))


@_query("tad_domains")
def _(spark, d):
    return tad.call_tad(events(spark, d), 1000, W * 1000, 3000)[0]


@_query("tad_bins")
def _(spark, d):
    return tad.call_tad(events(spark, d), 1000, W * 1000, stat_filter=False)[1]


_PARTS = """
l as (select l_orderkey o, l_linenumber ln, l_partkey // 20 b from lineitem),
pc as (select least(a.b, b.b) i, abs(a.b - b.b) k, count(*)::double v from l a join l b on a.o = b.o and a.ln < b.ln group by 1, 2),
size as (select max(p_partkey) // 20 + 1 n from part),
sums as (select r.i, coalesce(sum(s.v), 0) total from (select unnest(range(n)) i from size) r left join (select i, v from pc union all select i + k, v from pc) s on r.i = s.i group by 1)
"""


@_query("ingest_parts", f"with {_PARTS} select i::bigint i, k::bigint k, v from pc", raw=True)
def _(spark, d):
    return _out(parts(spark, d).cells.select("i", "k", "v"))


@_query("row_sums", f"with {_PARTS} select i::bigint i, total from sums", raw=True)
def _(spark, d):
    return _out(balance.row_sums(parts(spark, d)).select("i", "total"))


@_query("trim_sparse", f"with {_PARTS} select i::bigint i from sums where total <= (select list(total order by total)[ceil(0.1 * (select n from size))::bigint + 1] from sums)", raw=True)
def _(spark, d):
    return _out(balance.sparse_bins(parts(spark, d), 0.1).select("i"))


@_query("kr_bias")
def _(spark, d):
    return balance.compute_bin_bias(parts(spark, d), "parts")[0]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["diag_mean"](spark, sf_dir)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw contact list behind the matrices."""
    return events_coo(spark, sf_dir)


