"""Projection, cleaning and normalisation of market rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def safe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; anything unreadable, NaN or infinite becomes null."""
    out = {}
    for c in columns:
        v = F.col(c).try_cast("double")
        out[c] = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)
    return df.withColumns(out)


def signed_directional(df: DataFrame, flow: str, export_limit: str, import_limit: str) -> DataFrame:
    """Import capacity is minus the signed limit; negative values mean forced flow and stay."""
    return df.withColumns({"flow": F.col(flow), "export": F.col(export_limit), "import": -F.col(import_limit)})


def directional_rows(df: DataFrame, source: str, sink: str, keep: list[str]) -> DataFrame:
    """One row per direction with signed flow, headroom, utilisation and forced flag."""
    def side(name, sign, capacity, tight, a, b):
        return F.struct(F.lit(name).alias("direction"), (sign * F.col("flow")).alias("directional_flow"),
                        F.col(capacity).alias("capacity"), F.col(tight).alias("tight_capacity"),
                        F.col(a).alias("source"), F.col(b).alias("sink"))
    both = F.array(side("forward", F.lit(1.0), "export", "export_tight", source, sink),
                   side("reverse", F.lit(-1.0), "import", "import_tight", sink, source))
    d = df.select(*keep, F.explode(both).alias("_d")).select(*keep, "_d.*")
    cap, flow = F.col("capacity"), F.col("directional_flow")
    return d.withColumns({"headroom": cap - flow,
                          "utilization": F.when((cap > 0) & (flow > 0), flow / cap),
                          "forced_direction": (cap < 0).cast("int")})


def provider_normalise(df: DataFrame, regions: dict, variables: dict, units: DataFrame, *, source: str,
                       label: str = "end", minutes: int = 30) -> DataFrame:
    """Provider rows (issue, received, delivery, region, variable, member, value) to the
    long forecast form.  ``units`` is a small table (variable, factor, offset)."""
    def renamed(c, names):
        flat = [F.lit(x) for kv in names.items() for x in kv]
        return F.coalesce(F.try_element_at(F.create_map(*flat), F.col(c)), F.col(c)) if flat else F.col(c)
    shift = F.expr(f"interval {minutes} minutes")
    out = df.withColumns({"region": renamed("region", regions), "variable": renamed("variable", variables),
                          "delivery": F.col("delivery") + shift if label == "start" else F.col("delivery")})
    out = (out.join(units, "variable").withColumn("value", F.col("value") * F.col("factor") + F.col("offset"))
           .drop("factor", "offset")
           .withColumns({"source": F.lit(source), "run_id": F.col("issue").cast("string")}))
    done = out.groupBy("run_id", "issue").agg(F.max("received").alias("receipt_completed"))
    return out.join(done, ["run_id", "issue"])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def scenario_override(df: DataFrame, overrides: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Replace matched cells and tag the assumption."""
    o = overrides.select(*keys, F.col(value).alias("_new"))
    return (df.join(o, keys, "left")
            .withColumn("assumption", F.when(F.col("_new").isNotNull(), F.lit(name)))
            .withColumn(value, F.coalesce("_new", value)).drop("_new"))


def unmatched_overrides(df: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    return overrides.join(df.select(*keys), keys, "left_anti")


def outage_edits(snapshot: DataFrame, edits: DataFrame, origin: Column, name: str) -> DataFrame:
    """Apply cancel, update and add rows (keyed by outage_id) to a booking snapshot."""
    cancel = edits.filter("action = 'cancel'").select("outage_id")
    change = edits.filter("action = 'update'").select(
        "outage_id", *[F.col(c).alias(f"_{c}") for c in ("start", "end", "status")])
    kept = snapshot.join(cancel, "outage_id", "left_anti").join(change, "outage_id", "left")
    kept = kept.withColumns({c: F.coalesce(f"_{c}", c) for c in ("start", "end", "status")}).drop(
        "_start", "_end", "_status")
    new = edits.filter("action = 'add'").drop("action").withColumns({"issue": origin, "received": origin})
    return kept.unionByName(new, allowMissingColumns=True).withColumn("scenario", F.lit(name))


def outage_scenarios(active: DataFrame, hours: int) -> DataFrame:
    """Baseline, no planned outages, planned outages extended, from one scan."""
    planned = F.lower("status") == "planned"
    names = F.when(planned, F.array(F.lit("baseline"), F.lit(f"planned_extended_{hours}h"))).otherwise(
        F.array(F.lit("baseline"), F.lit("no_planned_outages"), F.lit(f"planned_extended_{hours}h")))
    d = active.filter(F.lower("status") != "cancelled").withColumn("scenario", F.explode(names))
    longer = planned & F.col("scenario").startswith("planned_extended")
    return d.withColumn("end", F.when(longer, F.col("end") + F.expr(f"interval {hours} hours")).otherwise(F.col("end")))


def canonical_inequality(df: DataFrame, kind: str, rhs: str, factor: str) -> DataFrame:
    """Write every >= row as <= by changing signs."""
    flip = F.when(F.col(kind) == ">=", -1.0).otherwise(1.0)
    return df.withColumns({rhs: F.col(rhs) * flip, factor: F.col(factor) * flip,
                           kind: F.when(F.col(kind) == ">=", "<=").otherwise(F.col(kind))})


def ordinary_price(flags: Column, suspended: Column) -> Column:
    """No administered, suspended or intervention bits (1, 2, 8); unknown flags are not ordinary."""
    return flags.isNotNull() & (F.coalesce(flags, F.lit(0)).bitwiseAND(11) == 0) & (
        F.coalesce(suspended, F.lit(1)) == 0)


def flag_bits(df: DataFrame, flags: str, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.when(F.col(flags).isNotNull(), F.bit_get(F.col(flags), F.lit(i)).cast("int"))
                           for i, n in enumerate(names)})


def dated_step(t: Column, steps: list[tuple[str, float]]) -> Column:
    """Value of a short dated schedule [(from, value), ...]; the first also holds before its date."""
    out = F.lit(float(steps[0][1]))
    for start, value in steps[1:]:
        out = F.when(t >= F.lit(start).cast("timestamp_ntz"), F.lit(float(value))).otherwise(out)
    return out


def era_label(df: DataFrame, eras: DataFrame, key: str, t: str) -> DataFrame:
    """Era by key and date; eras is a small table (key, era, era_from, era_to)."""
    e = eras.withColumnRenamed(key, "_ek")
    on = (F.col(key) == F.col("_ek")) & (F.col(t) >= F.col("era_from")) & (
        F.col("era_to").isNull() | (F.col(t) < F.col("era_to")))
    return df.join(e, on, "left").withColumn("era", F.coalesce("era", F.lit("all"))).drop("_ek", "era_from", "era_to")


def live_bookings(df: DataFrame, key: str, status: str, successor: str, dropped: list[str]) -> DataFrame:
    """Leave out withdrawn bookings and those whose named successor exists."""
    ids = df.select(F.col(key).alias(successor)).distinct()
    alive = df.filter(~F.coalesce(F.upper(F.trim(status)).isin(dropped), F.lit(False)))
    return alive.join(ids, successor, "left_anti")


def residual_demand(demand: Column, wind: Column, solar: Column) -> Column:
    """Demand is already net of rooftop output, so rooftop is not taken off again."""
    return demand - wind - solar


