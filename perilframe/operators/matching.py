"""Matching third-party rows to portfolio sites, and applying what they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions import text
from ..functions.common import blank_to_null, by_shuffle
from ..functions.profile import is_blank


GRAM = 4  # letters of the pieces by which names that may hold each other are looked up


def grams(x: Column, n: int = GRAM) -> Column:
    """Distinct pieces of n letters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(x) - n + 1)
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def gram_probes(inner: DataFrame, outer: DataFrame, x: str, y: str) -> DataFrame:
    """inner with _gram and its frequency _df among the texts y: the piece of x by which x is looked up in y.

    A text that holds x holds all its pieces, so the piece that the fewest texts hold is enough. A text x with a piece
    that none holds is in none and drops out. x shorter than a piece is looked up as it is.
    """
    df = outer.select(F.explode(grams(F.col(y))).alias("_gram")).groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    pieces = inner.where(F.length(x) >= GRAM).select(x, F.size(grams(F.col(x))).alias("_n"), F.explode(grams(F.col(x))).alias("_gram")).join(by_shuffle(df), "_gram")
    rarest = pieces.groupBy(x).agg(F.min(F.struct("_df", "_gram")).alias("_r"), F.count(F.lit(1)).alias("_met"), F.first("_n").alias("_n"))
    probes = inner.join(by_shuffle(rarest.where("_met = _n").select(x, "_r.*")), x)
    return probes.unionByName(inner.where(F.length(x) < GRAM).select("*", F.lit(None).cast("long").alias("_df"), F.col(x).alias("_gram")))


def contained_in(inner: DataFrame, outer: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of inner and outer whose text x is a part of text y; both texts distinct and not empty.

    An equi-join on pieces, of which a text has as many as letters, then a look at the whole texts. Words that many
    names share are never looked up while a name has a rarer piece.
    """
    every = F.concat(grams(F.col(y)), *[grams(F.col(y), n) for n in range(1, GRAM)])
    return (gram_probes(inner, outer, x, y).drop("_df").join(by_shuffle(outer.withColumn("_gram", F.explode(every))), "_gram")
            .where(F.contains(F.col(y), F.col(x))).drop("_gram"))


def match_names(queries: DataFrame, sites: DataFrame, name: str, query_id: str | None = None,
                site_id: str = "site_id") -> DataFrame:
    """Site per distinct query text: id equal, then normalised name equal, then containment.

    Within a tier the first site in order (lowest site_key) wins. Containment looks only at what
    the first two tiers left over, through the rarest piece of the shorter name (contained_in).
    Result: the distinct query columns, site_key and tier (null when unmatched).
    """
    cols = [name] + ([query_id] if query_id else [])
    q = queries.select(*cols).distinct()
    key = F.lower(F.trim(F.col(query_id))) if query_id else F.lower(F.trim(F.col(name)))
    q = q.withColumn("_id", blank_to_null(key)).withColumn("_norm", text.normal_name(F.col(name)))
    ids = (sites.select(F.lower(F.trim(F.col(site_id))).alias("_id"), "site_key").where(F.col("_id") != "")
           .groupBy("_id").agg(F.min("site_key").alias("_k1")))
    names = (sites.select(text.normal_name(F.col("name")).alias("_norm"), "site_key").where(F.col("_norm").isNotNull())
             .groupBy("_norm").agg(F.min("site_key").alias("_k2")))
    q = q.join(by_shuffle(ids), "_id", "left").join(by_shuffle(names), "_norm", "left")
    if query_id is None:
        # a blank normalised name matches nothing, not even by id
        q = q.withColumn("_k1", F.when(F.col("_norm").isNotNull(), F.col("_k1")))
    left = q.where(F.col("_k1").isNull() & F.col("_k2").isNull() & F.col("_norm").isNotNull()).select("_norm").distinct()
    sited = names.withColumnRenamed("_norm", "_site")
    inside = contained_in(sited, left, "_site", "_norm").select("_norm", "_k2")
    around = contained_in(left, sited, "_norm", "_site").select("_norm", "_k2")
    contained = inside.unionByName(around).groupBy("_norm").agg(F.min("_k2").alias("_k3"))
    q = q.join(by_shuffle(contained), "_norm", "left")
    tier = F.when(F.col("_k1").isNotNull(), 1).when(F.col("_k2").isNotNull(), 2).when(F.col("_k3").isNotNull(), 3)
    return q.select(*cols, F.coalesce("_k1", "_k2", "_k3").alias("site_key"), tier.alias("tier"))


def attach_match(rows: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    """Bring the matched site back to every row, null-safe on the query columns."""
    m = matches.select(*[F.col(c).alias(f"_q_{c}") for c in on], "site_key", "tier")
    cond = None
    for c in on:
        eq = rows[c].eqNullSafe(m[f"_q_{c}"])
        cond = eq if cond is None else cond & eq
    return rows.join(by_shuffle(m), cond, "left").drop(*[f"_q_{c}" for c in on])


def pack_join(pack_sites: DataFrame, sites: DataFrame) -> DataFrame:
    """Pack rows to portfolio sites by site id, then by name, case-insensitive; first site wins."""
    low = lambda c: blank_to_null(F.lower(F.trim(F.col(c))))
    by = lambda c, out: (sites.select(low(c).alias("_m"), "site_key").where(F.col("_m").isNotNull())
                         .groupBy("_m").agg(F.min("site_key").alias(out)))
    rows = (pack_sites.withColumn("_i", low("site_id")).withColumn("_n", low("name"))
            .join(by("site_id", "_a").withColumnRenamed("_m", "_i"), "_i", "left")
            .join(by("name", "_b").withColumnRenamed("_m", "_n"), "_n", "left"))
    return rows.select(*pack_sites.columns, F.coalesce("_a", "_b").alias("matched_site_key"))


def schedule_fields(rows: DataFrame) -> DataFrame:
    """Usable facts of a schedule row. Missing source columns count as absent."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    tiv = text.sov_money_of(has("tiv"))
    derived = text.sov_money_of(has("building")) + F.coalesce(text.sov_money_of(has("contents")), F.lit(0.0))
    tiv = F.coalesce(tiv, derived)
    tenure = F.lower(F.trim(has("owned_or_leased")))
    year = has("year_built").try_cast("double")
    return rows.select(
        "*", blank_to_null(has("campus_code")).alias("n_campus_code"),
        blank_to_null(has("campus_name")).alias("n_campus_name"),
        blank_to_null(has("named_insured")).alias("n_named_insured"),
        F.when(tenure.rlike("^own"), "owned").when(tenure.rlike("^leas|^rent"), "leased").alias("n_owned_or_leased"),
        text.sov_money_of(has("bi_ee")).alias("n_bi_ee_usd"), text.sov_money_of(has("premium")).alias("n_premium_annual_usd"),
        F.when(tiv > 0.0, tiv).alias("n_asset_value_usd"),
        blank_to_null(has("site_id")).alias("n_site_id"),
        F.when(text.is_timeshare(has("occupancy")), 1.0).alias("n_timeshare_share"),
        text.construction_class(has("construction_text")).alias("n_construction"),
        F.when((year > 1800) & (year < 2100), F.round(year)).alias("n_year_built"))


SUPERSEDE = ["campus_code", "campus_name", "named_insured", "owned_or_leased", "bi_ee_usd", "premium_annual_usd", "asset_value_usd"]
FILL = ["site_id", "timeshare_share", "construction", "year_built"]


def apply_schedule(sites: DataFrame, schedule: DataFrame, order: str = "row_no") -> DataFrame:
    """Schedule facts onto sites: policy facts replace, profile fields only fill blanks.

    When several rows match one site, rows apply in order: the last non-null fact replaces, the
    first non-null value fills. applied names the fields that changed hands.
    """
    rows = schedule_fields(schedule)
    m = match_names(rows, sites, "name", "site_id")
    hit = attach_match(rows, m, ["name", "site_id"]).where(F.col("site_key").isNotNull())
    last = [F.max_by(f"n_{c}", F.when(F.col(f"n_{c}").isNotNull(), F.col(order))).alias(f"n_{c}") for c in SUPERSEDE]
    first = [F.min_by(f"n_{c}", F.when(F.col(f"n_{c}").isNotNull(), F.col(order))).alias(f"n_{c}") for c in FILL]
    facts = hit.groupBy("site_key").agg(*last, *first, F.count("*").alias("schedule_rows"))
    df = sites.join(facts, "site_key", "left")
    for c in SUPERSEDE + FILL:
        if c not in sites.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c == "owned_or_leased" else "double"))
    empty = {c: (F.col(c).isNull() | (F.col(c).cast("string") == "")) for c in FILL}
    applied = F.array_compact(F.array(*[F.when(F.col(f"n_{c}").isNotNull(), c) for c in SUPERSEDE],
                                      *[F.when(F.col(f"n_{c}").isNotNull() & empty[c], c) for c in FILL]))
    keep = [c for c in df.columns if not c.startswith("n_") and c not in SUPERSEDE + FILL]
    return df.select(*keep, *[F.coalesce(f"n_{c}", c).alias(c) for c in SUPERSEDE],
                     *[F.when(empty[c], F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in FILL],
                     applied.alias("schedule_fields"))


def unmatched_schedule(schedule: DataFrame, sites: DataFrame) -> DataFrame:
    """Schedule rows that match no site, with the value they carry."""
    rows = schedule_fields(schedule)
    m = match_names(rows, sites, "name", "site_id")
    return (attach_match(rows, m, ["name", "site_id"]).where(F.col("site_key").isNull())
            .select("name", F.coalesce("n_asset_value_usd", F.lit(0.0)).alias("tiv")))


def bootstrap_sites(schedule: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A portfolio from a schedule with coordinates: (sites, rejected rows)."""
    rows = schedule_fields(schedule).withColumn("latitude", text.number_of(F.col("latitude"))).withColumn(
        "longitude", text.number_of(F.col("longitude")))
    ok = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
                    & (F.col("n_asset_value_usd") > 0.0), F.lit(False))
    named = F.coalesce(blank_to_null(F.col("name")), F.col("n_site_id"))
    good = rows.where(ok).select(named.alias("name"), "latitude", "longitude",
                                 *[F.col(f"n_{c}").alias(c) for c in SUPERSEDE + FILL])
    return good, rows.where(~ok)


def fill_blanks(sites: DataFrame, found: DataFrame, fields: list[str], source: str) -> tuple[DataFrame, DataFrame]:
    """Enrichment: fill only blank fields; (sites, provenance of filled and kept fields)."""
    cand = found.select("site_key", *[F.col(f).alias(f"_n_{f}") for f in fields])
    df = sites.join(cand, "site_key", "left")
    filled = lambda f: is_blank(F.col(f)) & F.col(f"_n_{f}").isNotNull()
    kept = lambda f: ~is_blank(F.col(f)) & F.col(f"_n_{f}").isNotNull()
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n_{f}").cast("string").alias("value"),
                                 F.when(filled(f), "filled").when(kept(f), "kept").alias("action")) for f in fields])
    prov = (df.select("site_key", F.explode(entries).alias("_p")).select("site_key", "_p.*")
            .where(F.col("action").isNotNull())
            .withColumn("source", F.lit(source)).withColumn("needs_review", F.col("action") == "filled"))
    out = df.select(*[F.when(filled(c), F.col(f"_n_{c}").cast(t)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
                      for c, t in sites.dtypes])
    return out, prov


def brand_settings(sites: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Finance settings per site: a brand override replaces only the values it names.

    The override table has one row per brand.
    """
    base = {"revenue_ratio": A.REVENUE_RATIO, "gop_margin": A.GOP_MARGIN, "reopen_months": A.REOPEN_MONTHS, "heat_drop": A.HEAT_DROP}
    drop = [c for c in ("revenue_usd", *base) if c in sites.columns]
    df = sites.drop(*drop)
    if overrides is None:
        df = df.select("*", *[F.lit(v).alias(k) for k, v in base.items()])
    else:
        o = overrides.select("brand", *[(F.col(k) if k in overrides.columns else F.lit(None)).cast("double").alias(f"_o_{k}") for k in base])
        df = df.join(o, "brand", "left").select(*df.columns, *[F.coalesce(f"_o_{k}", F.lit(v)).alias(k) for k, v in base.items()])
    revenue = F.when(F.col("annual_revenue_usd") > 0.0, F.col("annual_revenue_usd")).otherwise(F.col("asset_value_usd") * F.col("revenue_ratio"))
    return df.withColumn("revenue_usd", revenue)
