"""Full data against a subset."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import distribution as dist
from spanforge.operators import joins
from spanforge.plans.registry import R6, query, with_ctes
from spanforge.plans.stats_plans import rounded
from spanforge.sources import views

PRICES = """
rows AS (SELECT l_extendedprice AS v, l_quantity AS q, CASE WHEN substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 1) < '6' THEN 1 ELSE 0 END AS in_subset FROM lineitem)
"""
CURVES = """
counts AS (SELECT v, count(*) AS f, sum(in_subset) AS s FROM rows GROUP BY v),
cum AS (SELECT v, f, sum(f) OVER w / sum(f) OVER () AS cf, sum(s) OVER w / sum(s) OVER () AS cs, lead(v) OVER (ORDER BY v) AS nx
        FROM counts WINDOW w AS (ORDER BY v)),
size AS (SELECT count(*) AS nf, CAST(sum(in_subset) AS BIGINT) AS ns FROM rows)
"""


def prices(spark, sf):
    member = F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 1) < "6"
    return views.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"), member.cast("int").alias("in_subset")
    )


@query(
    "ks_two_sample",
    with_ctes(
        PRICES,
        CURVES,
        """stat AS (SELECT max(abs(cf - cs)) AS d, any_value(nf) AS nf, any_value(ns) AS ns FROM cum, size)""",
        """x AS (SELECT *, sqrt(nf::DOUBLE * ns / (nf + ns)) * d AS x FROM stat)""",
        body=f"""SELECT {R6("d")} AS statistic, nf AS n_full, ns AS n_sub, {R6('''CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(
        list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * CAST(k AS DOUBLE) * k * x * x))))) END''')} AS p_value FROM x""",
    ),
)
def ks_two_sample(spark, sf):
    return rounded(dist.ks_two_sample(prices(spark, sf), "v", exact_up_to=0))


LENGTHS = """
rows AS (SELECT CAST(n_chars AS DOUBLE) AS v, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS in_subset FROM documents)
"""


@query(
    "ks_two_sample_exact",
    with_ctes(
        LENGTHS,
        CURVES,
        """stat AS (SELECT max(abs(cf - cs)) AS d, any_value(nf) AS nf, any_value(ns) AS ns FROM cum, size)""",
        # Shares of paths that have left the band, one anti-diagonal after another.
        """walk AS (
          SELECT d, nf, ns, round(d * nf * ns) AS h, 0 AS s, list_transform(range(0, nf + 1), lambda i: 0.0::DOUBLE) AS row FROM stat
          UNION ALL
          SELECT d, nf, ns, h, s + 1, list_transform(range(0, nf + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > ns THEN 0.0::DOUBLE
            WHEN abs(i * ns - (s + 1 - i) * nf) >= h THEN 1.0::DOUBLE
            ELSE ((s + 1 - i) * row[i + 1] + i * coalesce(row[i], 0)) / (s + 1) END) FROM walk WHERE s < nf + ns)""",
        body=f"""SELECT {R6("d")} AS statistic, nf AS n_full, ns AS n_sub, {R6("row[nf + 1]")} AS p_value FROM walk WHERE s = nf + ns""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def ks_two_sample_exact(spark, sf):
    """Lengths of the labelled documents against those of all."""
    labelled = views.table(spark, sf, "labels").select("doc_id").distinct().withColumn("in_subset", F.lit(1))
    docs = views.table(spark, sf, "documents").join(labelled, "doc_id", "left")
    lengths = docs.select(F.col("n_chars").cast("double").alias("v"), F.coalesce("in_subset", F.lit(0)).alias("in_subset"))
    return rounded(dist.ks_two_sample(lengths, "v"))


@query(
    "wasserstein_1d",
    with_ctes(
        PRICES,
        CURVES,
        body=f"""SELECT {R6("sum(abs(cf - cs) * (nx - v))")} AS distance, {R6("sum(abs(cf - cs) * (nx - v)) / (sum(v * f) / sum(f)) * 100")} AS relative_error_pct FROM cum""",
    ),
)
def wasserstein_1d(spark, sf):
    return rounded(dist.wasserstein_1d(prices(spark, sf), "v"))


WIDTH = 2500.5


def bins_to(df, value, width):
    """As many bins as hold the largest value."""
    return int(df.agg(F.floor(F.max(value) / F.lit(width))).first()[0] or 0) + 1


EDGES = """n_bins AS (SELECT CAST(floor(max(v) / 2500.5::DOUBLE) AS BIGINT) + 1 AS n FROM rows),
edges AS (SELECT bin, bin * 2500.5::DOUBLE AS lo, (bin + 1) * 2500.5::DOUBLE AS hi FROM (SELECT unnest(range(0, n)) AS bin FROM n_bins))"""
BINS = """
bins AS (SELECT bin, count(v) AS n_full, CAST(coalesce(sum(in_subset), 0) AS BIGINT) AS n_sub FROM edges LEFT JOIN rows
  ON v >= lo AND v < hi GROUP BY bin)
"""


@query("histogram", with_ctes(PRICES, EDGES, BINS, body="SELECT * FROM bins"))
def histogram(spark, sf):
    rows = prices(spark, sf)
    return dist.histogram(rows, "v", WIDTH, bins_to(rows, "v", WIDTH))


@query(
    "histogram_integer_edges",
    with_ctes(
        PRICES,
        body="""SELECT CAST(bin AS BIGINT) AS bin, count(v) AS n_full, CAST(coalesce(sum(in_subset), 0) AS BIGINT) AS n_sub FROM range(10) t(bin)
        LEFT JOIN rows ON q >= bin * 5 AND (q < (bin + 1) * 5 OR (bin = 9 AND q = 50)) GROUP BY bin""",
    ),
)
def histogram_integer_edges(spark, sf):
    return dist.histogram(prices(spark, sf), "q", 5.0, 10)


def tail_sql(stat, df):
    """Upper tail of the chi-squared distribution: one minus the converging series of the lower gamma function."""
    term = f"exp(({df} / 2.0 + k) * ln({stat} / 2.0) - {stat} / 2.0 - lgamma({df} / 2.0 + 1 + k))"
    return f"greatest(0, 1 - list_sum(list_transform(range(0, CAST({stat} + 2000 AS BIGINT)), lambda k: {term})))"


@query(
    "chi2_binned",
    with_ctes(
        PRICES,
        EDGES,
        BINS,
        """sc AS (SELECT sum(in_subset) / count(*) AS k FROM rows)""",
        """walk AS (
          SELECT 0::BIGINT AS nxt, 0::DOUBLE AS o, 0::DOUBLE AS e, 0 AS grp, 0::DOUBLE AS co, 0::DOUBLE AS ce
          UNION ALL
          SELECT nxt + 1,
            CASE WHEN w.e + b.n_full * k >= 5 THEN 0 ELSE w.o + n_sub END, CASE WHEN w.e + b.n_full * k >= 5 THEN 0 ELSE w.e + b.n_full * k END,
            CASE WHEN w.e + b.n_full * k >= 5 THEN grp + 1 ELSE grp END, w.o + n_sub, w.e + b.n_full * k
          FROM walk w JOIN bins b ON b.bin = w.nxt, sc)""",
        """groups AS (SELECT grp, max(co) FILTER (WHERE e = 0) AS o, max(ce) FILTER (WHERE e = 0) AS e FROM walk WHERE nxt > 0 AND e = 0 AND ce >= 5 GROUP BY grp)""",
        """rest AS (SELECT o, e FROM walk WHERE nxt = (SELECT n FROM n_bins))""",
        """merged AS (SELECT g.grp, g.o + CASE WHEN g.grp = (SELECT max(grp) FROM groups) THEN (SELECT o FROM rest) ELSE 0 END AS o,
             g.e + CASE WHEN g.grp = (SELECT max(grp) FROM groups) THEN (SELECT e FROM rest) ELSE 0 END AS e FROM groups g)""",
        """scaled AS (SELECT o, e * (SELECT sum(o) / sum(e) FROM merged) AS e FROM merged)""",
        """tested AS (SELECT sum((o - e) * (o - e) / e) AS chi2, count(*) - 1 AS df FROM scaled)""",
        body=f"SELECT {R6('chi2')} AS chi2, df, {R6(tail_sql('chi2', 'df'))} AS p_value FROM tested",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def chi2_binned(spark, sf):
    rows = prices(spark, sf)
    return rounded(dist.chi2_binned(rows, "v", WIDTH, bins_to(rows, "v", WIDTH)))


@query(
    "chi2_p_value",
    with_ctes(
        PRICES,
        """kinds AS (SELECT CAST(q AS BIGINT) AS bin, count(*) AS f, sum(in_subset) AS s FROM rows GROUP BY 1)""",
        """t AS (SELECT sum(f)::DOUBLE AS f, sum(s)::DOUBLE AS s FROM kinds)""",
        """tested AS (SELECT sum(power(k.s - k.f / t.f * t.s, 2) / (k.f / t.f * t.s)) AS chi2, count(*) - 1 AS df FROM kinds k, t)""",
        body=f"SELECT {R6('chi2')} AS chi2, df, {R6(tail_sql('chi2', 'df'))} AS p_value FROM tested",
    ),
)
def chi2_p_value(spark, sf):
    rows = prices(spark, sf).select(F.col("q").cast("long").alias("label"), "in_subset")
    return rounded(dist.category_divergence(dist.category_counts(rows)).drop("jsd"))


def labelled(spark, sf):
    orders = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    people = views.table(spark, sf, "customer").select(
        "c_custkey", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("label")
    )
    subset = views.table(spark, sf, "lineitem").filter("l_quantity > 49 and l_tax > 0.07").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    flagged = joins.subset_semi_join(orders, subset, ["o_orderkey"])
    return dist.category_counts(joins.lookup_join(flagged, people, ["c_custkey"]))


LABELLED = """
cats AS (SELECT c_nationkey || '/' || c_mktsegment AS label, count(*) AS n_full,
  count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07)) AS n_sub
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


@query("category_counts", with_ctes(LABELLED, body="SELECT * FROM cats"))
def category_counts(spark, sf):
    return labelled(spark, sf)


@query(
    "category_coverage",
    with_ctes(
        LABELLED,
        body=f"""SELECT count(*) AS n_categories_full, count(*) FILTER (WHERE n_sub > 0) AS n_categories_subset,
        {R6("count(*) / 200 * 100")} AS coverage_full_pct, {R6("count(*) FILTER (WHERE n_sub > 0) / 200 * 100")} AS coverage_pct FROM cats""",
    ),
)
def category_coverage(spark, sf):
    return rounded(dist.category_coverage(labelled(spark, sf)))


@query(
    "top_categories",
    with_ctes(
        LABELLED,
        body=f"""SELECT label, n_full, n_sub, {R6("n_full / (SELECT sum(n_full) FROM cats) * 100")} AS full_pct,
        {R6("n_sub / (SELECT sum(n_sub) FROM cats) * 100")} AS sub_pct FROM cats ORDER BY n_full DESC, label LIMIT 20""",
    ),
)
def top_categories(spark, sf):
    return rounded(dist.top_categories(labelled(spark, sf)))


@query(
    "category_divergence",
    with_ctes(
        LABELLED,
        """t AS (SELECT sum(n_full)::DOUBLE AS f, sum(n_sub)::DOUBLE AS s FROM cats)""",
        """pq AS (SELECT n_sub, n_full / f * s AS e, n_sub / s AS p, n_full / f AS q FROM cats, t)""",
        """tested AS (SELECT sum((n_sub - e) * (n_sub - e) / e) AS chi2, count(*) - 1 AS df FROM pq)""",
        body=f"""SELECT {R6("any_value(chi2)")} AS chi2, any_value(df) AS df, {R6(tail_sql("any_value(chi2)", "any_value(df)"))} AS p_value,
        {R6("0.5 * sum(p * ln(p / (0.5 * (p + q) + 1e-12) + 1e-12)) + 0.5 * sum(q * ln(q / (0.5 * (p + q) + 1e-12) + 1e-12))")} AS jsd FROM pq, tested""",
    ),
)
def category_divergence(spark, sf):
    return rounded(dist.category_divergence(labelled(spark, sf)))


@query("missing_members", with_ctes(LABELLED, body="SELECT label FROM cats WHERE n_sub = 0"))
def missing_members(spark, sf):
    return dist.missing_members(labelled(spark, sf))
