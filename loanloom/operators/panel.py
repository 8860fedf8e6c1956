"""Monthly panel: ordering, carry-forward, running sums, first events, last row.

Every panel operator needs "what happened on this loan's earlier rows".  For an
ordinary loan (at most a few hundred months) that is one window over the loan.
A loan id that holds a large part of the table (a placeholder id, say) would put
all its rows into one task, so such ids are scanned in blocks instead: blocks are
consecutive slices of the loan's own (period, row_seq) order with about equally
many rows, each is summarised by an aggregate, the summaries are carried forward,
and the rows are then finished block by block.  Both ways are in every plan and
give the same rows; which loans are big is counted when the plan runs, and where
none is, adaptive execution leaves the blocks out.
"""

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions import loan as L
from loanloom.functions.dates import parse_day
from loanloom.functions.nulls import null_to_blank
from loanloom.operators.ranked import range_of

KEYS = ("loan_id",)
ORDER = ("period", "row_seq")

# A loan above this many rows is scanned in blocks, and in about this many blocks
# for each time it has so many.  Both bound what is broadcast: at most (panel rows
# / BIG_LOAN_ROWS) ids, and BLOCKS_EACH times as many places where blocks begin.
BIG_LOAN_ROWS = 1_000_000
BLOCKS_EACH = 8
BLOCK = ("block",)
# Copies of a row are written out in runs of this many.
RUN = 1 << 16


def prepare_panel(perf: DataFrame, row_seq: str | None = None, keys=KEYS) -> DataFrame:
    """Parse dates and codes and give every row its place in the loan's order.

    A missing key becomes blank text, so that such rows form a group of their
    own and joins need no extra null filters.

    Rows are ordered by period; ``row_seq`` names a bigint column that breaks
    ties (a file position).  Without one, a hash of the row's content does, so
    that the order does not depend on how the data was partitioned.
    """
    seq = F.col(row_seq).cast("bigint") if row_seq else F.xxhash64(*perf.columns)
    return perf.withColumns(
        {
            **{k: null_to_blank(F.col(k)) for k in keys},
            "period": parse_day(F.col("monthly_rpt_prd")),
            "disp_dt": parse_day(F.col("disp_dt")),
            "fcc_dte": parse_day(F.col("fcc_dte")),
            "delq": L.delinquency_months(F.col("delq_status")),
            "prin_forg_upb": L.forgiven_principal(
                F.col("prin_forg_upb_fhfa"), F.col("prin_forg_upb_oth")
            ),
            "row_seq": seq,
        }
    ).drop("monthly_rpt_prd", "delq_status", "prin_forg_upb_fhfa", "prin_forg_upb_oth")


@dataclass(frozen=True)
class PanelPart:
    """Panel rows whose loan is scanned the same way.

    ``block`` is empty for ordinary loans.  ``copies`` counts identical rows:
    always 1 for ordinary loans, pre-aggregated for big ones.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    block: tuple[str, ...] = ()
    big_keys: DataFrame | None = None

    def with_rows(self, rows: DataFrame) -> "PanelPart":
        return replace(self, rows=rows)

    def expand(self) -> DataFrame:
        """One output row per input row again, with ``copy`` numbered from 1."""
        if not self.block:
            return self.rows.withColumn("copy", F.lit(1).cast("bigint")).drop("copies")
        runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / RUN))
        within = F.least(F.col("copies") - F.col("copy_run") * RUN, F.lit(RUN).cast("bigint"))
        return (
            self.rows.withColumn("copy_run", F.explode(runs))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), within)))
            .withColumn("copy", F.col("copy_run") * RUN + F.col("copy"))
            .drop("copies", "copy_run", *self.block)
        )


def keys_above(df: DataFrame, keys, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows: at most (rows / limit) of them.

    The count combines on the map side, so a hot key costs nothing here, and
    only the key columns are read.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key"))
    return counted.filter(F.col("rows_of_key") > limit)


def split_by_size(
    panel: DataFrame, keys=KEYS, big_loan_rows: int | None = BIG_LOAN_ROWS
) -> list[PanelPart]:
    """Ordinary loans and big loans; either part may turn out empty when it runs.

    A big loan's blocks begin at rows drawn from its own order by hash: the
    more distinct places, the more draws, so blocks have about equally many
    and outlying positions do no harm.  Pass ``big_loan_rows=None`` to leave
    the second part out for a panel known to be unique by (loan, period).
    """
    keys = tuple(keys)
    one = F.lit(1).cast("bigint")
    if big_loan_rows is None:
        return [PanelPart(panel.withColumn("copies", one), keys)]
    counted = keys_above(panel, keys, big_loan_rows)
    big = counted.select(*keys)
    ordinary = panel.join(F.broadcast(big), list(keys), "left_anti")
    # identical rows are counted first
    copies = panel.join(F.broadcast(counted), list(keys)).groupBy(*panel.columns, "rows_of_key").agg(F.count(F.lit(1)).alias("copies"))
    order, drawn = F.struct(*ORDER), F.xxhash64(*ORDER)
    slot = F.pmod(drawn, F.ceil(F.col("rows_of_key") * BLOCKS_EACH / big_loan_rows))
    begins = (
        copies.groupBy(*keys, slot.alias("slot"))
        .agg(F.min_by(order, drawn).alias("begin"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("begin")).alias("begins"))
    )
    blocked = (
        copies.join(F.broadcast(begins), list(keys))
        .withColumn("block", range_of(order, F.col("begins")))
        .drop("rows_of_key", "begins")
    )
    return [PanelPart(ordinary.withColumn("copies", one), keys), PanelPart(blocked, keys, BLOCK, big)]


def earlier_rows(part: PanelPart, states: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add one column per state, computed over the loan's strictly earlier rows.

    A state is ``("sum", x)``, ``("last", x)`` for the latest non-missing x, or
    ``("first", x)`` for the loan's first x as a one-field struct ``v`` (which
    may hold a missing value, and includes the current row).
    """
    window = Window.partitionBy(*part.keys, *part.block).orderBy(*ORDER)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0)
    local = {
        name: {
            "sum": lambda x: F.coalesce(F.sum(x).over(before), zero),
            "last": lambda x: F.last(x, ignorenulls=True).over(before),
            "first": lambda x: F.first(F.struct(x.alias("v"))).over(upto),
        }[kind](x)
        for name, (kind, x) in states.items()
    }
    rows = part.rows.withColumns(local)
    if not part.block:
        return rows

    order = F.struct(*ORDER)
    summarise = {
        "sum": lambda x: F.sum(x),
        "last": lambda x: F.max_by(x, F.when(x.isNotNull(), order)),
        "first": lambda x: F.min_by(F.struct(x.alias("v")), order),
    }
    block_keys = (*part.keys, *part.block)
    summary = part.rows.groupBy(*block_keys).agg(
        *[summarise[kind](x).alias(name) for name, (kind, x) in states.items()]
    )
    # One row per block of a loan.
    blocks = Window.partitionBy(*part.keys).orderBy(*part.block)
    blocks_before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carry = {
        "sum": lambda c: F.coalesce(F.sum(c).over(blocks_before), zero),
        "last": lambda c: F.last(c, ignorenulls=True).over(blocks_before),
        "first": lambda c: F.first(c, ignorenulls=True).over(blocks_before),
    }
    carried = summary.select(
        *block_keys,
        *[carry[kind](F.col(name)).alias(name + "_c") for name, (kind, _) in states.items()],
    )
    combine = {
        "sum": lambda n: F.col(n) + F.col(n + "_c"),
        "last": lambda n: F.coalesce(F.col(n), F.col(n + "_c")),
        "first": lambda n: F.coalesce(F.col(n + "_c"), F.col(n)),
    }
    joined = rows.join(carried, list(block_keys))
    return joined.withColumns({n: combine[kind](n) for n, (kind, _) in states.items()}).drop(
        *[n + "_c" for n in states]
    )


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def scan(part: PanelPart) -> PanelPart:
    """Add ``month_no``, carried-forward ``upb`` and ``non_int``, and ``prev_upb``.

    Carry-forward replaces a missing or zero balance by the latest positive
    one; a leading gap takes the loan's first raw value, be it 0 or missing.
    """
    raw_upb, raw_non_int = F.col("last_upb"), F.col("non_int_upb")
    rows = earlier_rows(
        part,
        {
            "rows_before": ("sum", F.col("copies")),
            "upb_before": ("last", _positive(raw_upb)),
            "upb_first": ("first", raw_upb),
            "non_int_before": ("last", _positive(raw_non_int)),
            "non_int_first": ("first", raw_non_int),
        },
    )
    prior_upb = F.coalesce("upb_before", "upb_first.v")
    prior_non_int = F.coalesce("non_int_before", "non_int_first.v")
    rows = rows.withColumns(
        {
            "month_no": F.col("rows_before") + 1,
            "upb": F.coalesce(_positive(raw_upb), prior_upb),
            "non_int": F.coalesce(_positive(raw_non_int), prior_non_int),
            "prev_upb": F.when(F.col("rows_before") > 0, prior_upb),
        }
    )
    return part.with_rows(
        rows.drop("rows_before", "upb_before", "upb_first", "non_int_before", "non_int_first")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _expanded_scan(part: PanelPart) -> DataFrame:
    again = F.col("copy") > 1
    return (
        part.expand()
        .withColumn("prev_upb", F.when(again, F.col("upb")).otherwise(F.col("prev_upb")))
        .withColumn("month_no", F.col("month_no") + F.col("copy") - 1)
    )


def carry_forward(panel: DataFrame, keys=KEYS, big_loan_rows=BIG_LOAN_ROWS) -> DataFrame:
    """The prepared panel with the columns of :func:`scan`, row for row."""
    parts = [_expanded_scan(scan(p)) for p in split_by_size(panel, keys, big_loan_rows)]
    return _union(parts).drop("copy")


def original_rates(acq: DataFrame, keys=KEYS) -> DataFrame:
    """One origination rate per loan, so that adding it never multiplies rows."""
    named = acq.withColumns({k: null_to_blank(F.col(k)) for k in keys})
    return named.groupBy(*keys).agg(F.max("orig_rt").alias("orig_rt"))


def add_original_rate(panel: DataFrame, acq: DataFrame, keys=KEYS) -> DataFrame:
    """Update join: the origination rate on every panel row, NULL without one."""
    return panel.join(original_rates(acq, keys), list(keys), "left")


def modification_costs(
    panel: DataFrame, acq: DataFrame, keys=KEYS, big_loan_rows=BIG_LOAN_ROWS
) -> DataFrame:
    """Row-level modification costs and their running sums.

    Once a cost is missing, the running sum stays missing for the rest of the
    loan.
    """
    rates = original_rates(acq, keys)
    out = []
    for part in split_by_size(panel, keys, big_loan_rows):
        part_rates = rates
        if part.block:  # one rate per big loan: as bounded as the list of them
            few = rates.join(F.broadcast(part.big_keys), list(keys), "left_semi")
            part_rates = F.broadcast(few)
        priced = part.with_rows(part.rows.join(part_rates, list(keys), "left"))
        scanned = scan(priced)
        mod, rate = F.col("mod_flag"), F.col("last_rt")
        costs = scanned.with_rows(
            scanned.rows.withColumns(
                {
                    "modir_cost": L.rate_reduction_cost(mod, F.col("orig_rt"), rate, F.col("upb")),
                    "modfb_cost": L.forbearance_cost(mod, rate, F.col("non_int")),
                }
            )
        )
        states = {}
        for c in ("modir_cost", "modfb_cost"):
            states["sum_" + c] = ("sum", F.col(c) * F.col("copies"))
            states["gap_" + c] = ("sum", F.col(c).isNull().cast("bigint"))
        rows = _expanded_scan(costs.with_rows(earlier_rows(costs, states)))
        for c in ("modir_cost", "modfb_cost"):
            total = F.col("sum_" + c) + F.col("copy") * F.col(c)
            rows = rows.withColumn("c_" + c, F.when(F.col("gap_" + c) == 0, total))
        out.append(rows.drop(*states))
    return _union(out).drop("copy")


def fill_last_row(
    panel: DataFrame, column: str, keys=KEYS, big_loan_rows=BIG_LOAN_ROWS
) -> DataFrame:
    """Add ``<column>_filled``: a loan's closing gap takes the row before it."""
    value = F.col(column)
    out = []
    for part in split_by_size(panel, keys, big_loan_rows):
        rows = earlier_rows(part, {"previous": ("last", F.struct(value.alias("v")))})
        if part.block:
            ends = part.rows.groupBy(*keys).agg(F.max(F.struct(*ORDER)).alias("ends_at"))
            rows = rows.join(ends, list(keys)).withColumn(
                "is_last", (F.struct(*ORDER) == F.col("ends_at")) & (F.col("copies") == 1)
            )
        else:
            following = F.lead(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*ORDER))
            rows = rows.withColumn("is_last", following.isNull())
        gap = value.isNull() | (value == 0)
        fill = F.col("is_last") & gap & F.col("previous").isNotNull()
        rows = rows.withColumn(
            column + "_filled", F.when(fill, F.col("previous.v")).otherwise(value)
        )
        out.append(part.with_rows(rows.drop("previous", "is_last", "ends_at")).expand())
    return _union(out).drop("copy")


def last_rows(panel: DataFrame, keys=KEYS) -> DataFrame:
    """The closing row of every loan, by (period, row_seq).

    A map-side-combined aggregate: at most one row per loan and input partition
    is shuffled, and a big loan is no burden.  Each field is an aggregate of its
    own, so fields that nothing reads later are neither read nor shuffled.
    """
    rest = [c for c in panel.columns if c not in keys]
    return panel.groupBy(*keys).agg(*[F.max_by(F.col(c), order_number()).alias(c) for c in rest])


def order_number() -> Column:
    """:data:`ORDER` as one number, missing parts first: cheaper to compare than a struct."""
    day = F.coalesce(F.unix_date("period").cast("decimal(10,0)"), F.lit(-(10**7)).cast("decimal(10,0)"))
    # a missing position goes before the least one
    place = F.coalesce(F.col("row_seq").cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)))
    return (day * F.lit(Decimal(1 << 65)) + place).cast("decimal(38,0)")


def loan_flags(panel: DataFrame, keys=KEYS, big_loan_rows=BIG_LOAN_ROWS) -> DataFrame:
    """Loan-level modification flags and forgiven principal."""
    return _union(
        [_summarise(scan(p), _flag_aggregates()) for p in split_by_size(panel, keys, big_loan_rows)]
    )


def first_events(panel: DataFrame, keys=KEYS, big_loan_rows=BIG_LOAN_ROWS) -> DataFrame:
    """First modification, first credit event and first 180-day delinquency."""
    parts = split_by_size(panel, keys, big_loan_rows)
    out = _union([_summarise(scan(p), _event_aggregates()) for p in parts])
    return out.select(*keys, *event_columns())


def collapse(panel: DataFrame, keys=KEYS, big_loan_rows=BIG_LOAN_ROWS) -> DataFrame:
    """One row per loan: its closing row, flags, first events and cost sums.

    Everything a loan needs comes out of a single aggregate per loan that reuses
    the exchange of the scan; what nothing reads later is pruned, closing fields
    one by one.  The running modification costs are summed here
    without the origination rate, which enters once per loan afterwards.
    """
    dropped = ("prev_upb", "row_seq", "month_no", "last_upb", "non_int_upb", "copies", *BLOCK)
    out = []
    for part in split_by_size(panel, keys, big_loan_rows):
        scanned = scan(part)
        closing = [c for c in scanned.rows.columns if c not in (*keys, *dropped)]
        if part.block:
            last = [F.max_by(F.col(c), order_number()).alias(c) for c in closing]
        else:  # the scan's own order tells which row is the last
            following = F.lead(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*ORDER))
            scanned = scanned.with_rows(scanned.rows.withColumn("is_last", following.isNull()))
            last = [F.max(F.when(F.col("is_last"), F.col(c))).alias(c) for c in closing]
        measures = [*_flag_aggregates(), *_event_aggregates(), *_cost_aggregates()]
        out.append(_summarise(scanned, [*last, *measures]))
    loans = _union(out)
    events = ("fmod", "fce", "f180")
    return loans.select(*[c for c in loans.columns if c not in events], *event_columns())


def _summarise(part: PanelPart, aggregates: list[Column]) -> DataFrame:
    return part.rows.groupBy(*part.keys).agg(*aggregates)


def _flag_aggregates() -> list[Column]:
    is_mod = L.modified(F.col("mod_flag"))
    maturity = null_to_blank(F.col("maturity_date"))
    rise = is_mod & (F.col("upb") > F.col("prev_upb"))
    return [
        F.when(F.max(is_mod) & (F.min(maturity) != F.max(maturity)), 1)
        .otherwise(0)
        .alias("modtrm_chng"),
        F.max(F.when(rise, 1).otherwise(0)).alias("modupb_chng"),
        F.greatest(F.coalesce(F.max("prin_forg_upb"), F.lit(0.0)), F.lit(0.0)).alias("modfg_cost"),
    ]


def _event_aggregates() -> list[Column]:
    def first(cond: Column, *fields: str) -> Column:
        return F.min_by(F.struct(*fields), F.when(cond, F.struct(*ORDER)))

    delq = F.col("delq")
    credit = ("period", "upb", "delq", "month_no")
    return [
        first(L.modified(F.col("mod_flag")), "period", "upb").alias("fmod"),
        first(L.first_event_row(F.col("zero_bal_code"), delq), *credit).alias("fce"),
        first(L.severely_delinquent(delq), *credit).alias("f180"),
    ]


def event_columns() -> list[Column]:
    """Flat names for the event structs; ``*_delq`` and ``*_month`` feed the UPB rule."""
    out = [
        F.col("fmod.period").alias("fmod_dte"),
        F.col("fmod.upb").alias("fmod_upb"),
    ]
    for e in ("fce", "f180"):
        out += [
            F.col(f"{e}.period").alias(f"{e}_dte"),
            F.col(f"{e}.upb").alias(f"{e}_upb"),
            F.col(f"{e}.delq").alias(f"{e}_delq"),
            F.col(f"{e}.month_no").alias(f"{e}_month"),
        ]
    return out


def _cost_aggregates() -> list[Column]:
    is_mod = L.modified(F.col("mod_flag"))
    upb, rate, copies = F.col("upb"), F.col("last_rt"), F.col("copies")
    forborne = is_mod & F.col("non_int").isNotNull()
    # Sums of products first, the division once per loan: exact for longer.
    yearly = F.coalesce(F.sum(F.when(forborne, rate * F.col("non_int") * copies)), F.lit(0.0))
    return [
        F.max(is_mod).alias("ever_modified"),
        F.coalesce(F.sum(F.when(is_mod, upb * copies)), F.lit(0.0)).alias("mod_upb_sum"),
        F.coalesce(F.sum(F.when(is_mod, rate * upb * copies)), F.lit(0.0)).alias("mod_rate_upb_sum"),
        F.max(is_mod & (upb * rate).isNull()).alias("modir_gap"),
        F.when(F.count_if(forborne & rate.isNull()) == 0, yearly / 1200).alias("c_modfb_cost"),
    ]


def total_rate_reduction_cost(orig_rt: Column) -> Column:
    """Loan total of the rate-reduction cost from the sums of :func:`collapse`."""
    total = (orig_rt * F.col("mod_upb_sum") - F.col("mod_rate_upb_sum")) / 1200
    return F.when(~F.col("ever_modified"), F.lit(0.0)).when(~F.col("modir_gap"), total)
