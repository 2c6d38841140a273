"""Queries: counts, matrices, rates, statistics."""

from pyspark.sql import functions as F

from gabble.operators import report, stats
from gabble.plans import bindings as B
from gabble.plans import flows
from gabble.plans.bindings import round_sql, sql
from gabble.plans.queries_clean import TAGGED
from gabble.plans.queries_score import has_word_sql
from gabble.plans.registry import query

_MATRIX = ", ".join(
    f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in B.SENTIMENTS)


@query(sql("SELECT persoon, count(*) AS n FROM raw GROUP BY persoon", "raw"))
def agg_count_by_person(spark, d):
    return report.count_by(B.raw(spark, d), "persoon")


@query(sql("SELECT sentiment, count(*) AS n FROM scored GROUP BY sentiment", "scored"))
def agg_label_counts_null(spark, d):
    return report.label_counts(B.scored(spark, d), "sentiment", with_null=True)


@query(sql("""SELECT sentiment, count(*) AS n FROM scored WHERE sentiment IS NOT NULL
  GROUP BY sentiment""", "scored"))
def agg_label_counts(spark, d):
    return report.label_counts(B.scored(spark, d), "sentiment")


@query(sql(f"""SELECT persoon, {_MATRIX} FROM scored WHERE sentiment IS NOT NULL
  GROUP BY persoon""", "scored"))
def agg_pivot_labels(spark, d):
    return report.label_matrix(B.scored(spark, d), "persoon", "sentiment", B.SENTIMENTS)


@query(sql("""SELECT persoon, gender, sentiment, count(*) AS n FROM scored
  WHERE sentiment IS NOT NULL GROUP BY ALL""", "scored"))
def agg_label_long(spark, d):
    return report.label_counts_by(B.scored(spark, d), ["persoon", "gender"], "sentiment")


@query(sql(f"""SELECT persoon, gender, totaal, negatief,
  {round_sql('100.0 * negatief / totaal', 1)} AS pct_negatief
  FROM (SELECT persoon, gender, count(sentiment) AS totaal,
      count(*) FILTER (WHERE sentiment = 'negative') AS negatief
    FROM scored GROUP BY persoon, gender)""", "scored"))
def agg_negative_rate(spark, d):
    return report.negative_rate(B.scored(spark, d))


@query(sql(f"SELECT gender, {_MATRIX} FROM scored WHERE sentiment IS NOT NULL GROUP BY gender",
           "scored"))
def agg_crosstab(spark, d):
    return stats.crosstab(B.scored(spark, d), "gender", "sentiment", B.SENTIMENTS)


_RATE = f"""count(*) FILTER (WHERE negative) AS n_negative, count(*) AS n_rows,
  {round_sql('100.0 * count(*) FILTER (WHERE negative) / count(*)', 6)} AS pct_negative"""


@query(sql(f"SELECT gender, {_RATE} FROM scored GROUP BY gender", "scored"))
def agg_gender_rate(spark, d):
    return report.rate_by(B.scored(spark, d), ["gender"])


@query(sql(f"SELECT {_RATE} FROM scored", "scored"))
def agg_overall_rate(spark, d):
    return report.rate_by(B.scored(spark, d))


@query(sql("SELECT gender, count(*) AS n FROM scored WHERE negative GROUP BY gender", "scored"))
def agg_negative_by_gender(spark, d):
    return report.flagged_by(B.scored(spark, d))


@query(sql("""SELECT comment_id, persoon, comment FROM comments
  UNION ALL SELECT comment_id, persoon, comment FROM notes""", "comments", "notes"))
def union_entities(spark, d):
    return B.comments(spark, d).unionByName(B.notes(spark, d)).select(
        "comment_id", "persoon", "comment")


_CELLS = """counts AS (SELECT gender, sentiment, count(*) AS o FROM scored
    WHERE sentiment IS NOT NULL GROUP BY ALL),
  grid AS (SELECT g.gender, s.sentiment, coalesce(o, 0) AS o
    FROM (SELECT DISTINCT gender FROM counts) g CROSS JOIN (SELECT DISTINCT sentiment FROM counts) s
    LEFT JOIN counts c ON c.gender = g.gender AND c.sentiment = s.sentiment),
  cells AS (SELECT *, sum(o) OVER (PARTITION BY gender) AS r,
      sum(o) OVER (PARTITION BY sentiment) AS c, sum(o) OVER () AS n FROM grid)"""


@query(sql(f"""WITH {_CELLS} SELECT gender AS row_value, sentiment AS column_value,
  CAST(o AS BIGINT) AS observed, round(CAST(r AS DOUBLE) * c / n, 6) AS expected FROM cells""",
           "scored"))
def stat_expected(spark, d):
    return stats.cells(B.scored(spark, d), "gender", "sentiment", B.SENTIMENTS).select(
        "row_value", "column_value", "observed", F.round("expected", 6).alias("expected"))


@query(sql(f"""WITH {_CELLS}, test AS (
    SELECT sum((o - CAST(r AS DOUBLE) * c / n) ^ 2 / (CAST(r AS DOUBLE) * c / n)) AS x,
      (count(DISTINCT gender) - 1) * (count(DISTINCT sentiment) - 1) AS dof FROM cells)
  SELECT round(x, 6) AS statistic, CAST(dof AS BIGINT) AS dof, round(exp(-x / 2), 6) AS p_value,
    exp(-x / 2) < 0.05 AS significant FROM test""", "scored"))
def stat_chi_square(spark, d):
    test = stats.chi_square(B.scored(spark, d), "gender", "sentiment", B.SENTIMENTS)
    return test.select(F.round("statistic", 6).alias("statistic"), "dof",
                       F.round("p_value", 6).alias("p_value"), "significant")


@query(sql(f"""WITH {TAGGED} SELECT persoon, gender, totaal, negatief,
  {round_sql('100.0 * negatief / totaal', 1)} AS pct_negatief
  FROM (SELECT persoon, gender, count(*) AS totaal,
      count(*) FILTER (WHERE {has_word_sql(B.NEGATIVE)}) AS negatief
    FROM tagged WHERE drop_reason = '' GROUP BY persoon, gender)""", "raw"))
def negative_report(spark, d):
    return flows.negative_report(B.raw(spark, d), B.NEGATIVE)
