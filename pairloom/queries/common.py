"""Shared inputs of the registered queries, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import enrich as enrichment
from pairloom.operators.rank_cuts import assign_folds
from pairloom.session import spread, written
from pairloom.sources import views

VERSIONS = list(views.VERSIONS)
FOLDS = list(range(views.N_FOLDS))
# Token and bracket patterns as the SQL engine spells them.
TOKEN_SQL = r"\[sep\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
BRACKET_SQL = r"[\(\[\{].*?[\)\]\}]"


class Registry:
    """Collects the queries of a module, each next to its SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(build):
            self.queries[build.__name__] = build
            if sql is not None:
                self.sql[build.__name__] = sql
            return build

        return add


def with_ctes(*parts: str) -> str:
    """Named subqueries and the final select as one statement."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def sql_r6(expr: str) -> str:
    """Round, with a plain zero for tiny negative numbers."""
    return f"CASE WHEN abs({expr}) < 0.0000005 THEN 0.0 ELSE round({expr}, 6) END"


def sql_key(id_expr: str, *salts) -> str:
    return "md5(" + " || ':' || ".join([f"CAST({id_expr} AS VARCHAR)", *[f"'{s}'" for s in salts]]) + ")"


def sql_unit(key: str) -> str:
    return f"((CAST(CAST('0x' || substr({key}, 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / CAST(281474976710656 AS DOUBLE))"


# ---- Spark side -----------------------------------------------------------


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrich(views.pairs(spark, sf_dir), views.sections(spark, sf_dir), views.classes(spark, sf_dir))


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds first, on the narrow table: they need the label and the id only."""
    sections, classes = views.sections(spark, sf_dir), views.classes(spark, sf_dir)
    return enrichment.with_model_text(enrichment.enrich(folded(spark, sf_dir), sections, classes))


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.with_model_text(enriched(spark, sf_dir))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_folds(views.pairs(spark, sf_dir), "score", views.N_FOLDS, views.SEED)


def oof_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.with_predictions(folded(spark, sf_dir)).select("id", "fold", "score", *VERSIONS)


def stored_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction table as a training run leaves it: written once, read by every later step."""
    return written(oof_wide(spark, sf_dir), "oof")


def oof_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.predictions_long(folded(spark, sf_dir))


def test_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every version and fold model for the unlabelled pairs, in long form."""
    names = [f"{version}_fold_{fold}" for version in VERSIONS for fold in FOLDS]
    base = spread(views.test_pairs(spark, sf_dir).select("id")).withColumn("score", F.lit(0.5))
    wide = base.withColumns(
        {f"{v}_fold_{k}": views.prediction(w, v, k) for v, w in views.VERSIONS.items() for k in FOLDS}
    )
    long = wide.unpivot(["id"], names, "name", "pred")
    return long.select(
        "id",
        F.split_part("name", F.lit("_fold_"), F.lit(1)).alias("version"),
        F.split_part("name", F.lit("_fold_"), F.lit(2)).cast("int").alias("fold"),
        "pred",
    )


# ---- SQL side -------------------------------------------------------------

CODE_SQL = "chr(65 + n_regionkey) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"

PAIRS_SQL = f"""pairs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, lower(o_orderpriority) AS anchor, lower(c_mktsegment) AS target,
         {CODE_SQL} AS context,
         (CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) - 1) / 4 AS score
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

TEST_SQL = f"""test_pairs AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, lower(c_mktsegment) AS anchor, lower(n_name) AS target,
         {CODE_SQL} AS context
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

SECTIONS_SQL = "sections AS (SELECT chr(65 + r_regionkey) AS context_grp_1, lower(r_name) AS text_grp_1 FROM region)"

CLASSES_SQL = f"""class_keys AS (
  SELECT {CODE_SQL} AS context, lower(n_name) AS description, n_nationkey AS k, n_regionkey AS r
  FROM nation WHERE n_nationkey % 7 <> 0),
classes AS (
  SELECT a.context, a.description,
         CASE WHEN a.k % 5 <> 0 THEN
           (SELECT string_agg(b.context, '; ' ORDER BY b.context) FROM class_keys b
            WHERE b.r = a.r AND b.context <> a.context) END AS mentioned_groups
  FROM class_keys a)"""

ENRICHED_SQL = """enriched AS (
  SELECT p.*, substr(p.context, 1, 1) AS context_grp_1, s.text_grp_1, c.description AS text_grp_2,
         c.mentioned_groups AS mentioned_groups_grp_2
  FROM pairs p LEFT JOIN sections s ON s.context_grp_1 = substr(p.context, 1, 1)
  LEFT JOIN classes c ON c.context = p.context)"""

ENRICH_CTES = (PAIRS_SQL, SECTIONS_SQL, CLASSES_SQL, ENRICHED_SQL)

TEXT_SQL = """anchor || '[SEP]' || target || '[SEP]' || text_grp_1
  || CASE WHEN text_grp_2 IS NULL THEN '' ELSE '; ' || text_grp_2 END"""


def folds_sql(source: str, stratum: str, k: int, seed: int, name: str = "folds", id_col: str = "id") -> str:
    """Fold of each id: cut the key order of a stratum at the sizes of a dealt-out deck."""
    sizes = ", ".join(f"(start + n + {k - 1 - i}) // {k} - (start + {k - 1 - i}) // {k} AS f{i}" for i in range(k))
    cases = " ".join(f"WHEN r <= {' + '.join(f'f{j}' for j in range(i + 1))} THEN {i}" for i in range(k - 1))
    return f"""{name}_counts AS (SELECT {stratum} AS s, count(*) AS n FROM {source} GROUP BY 1),
{name}_starts AS (SELECT s, n, CAST(sum(n) OVER (ORDER BY s) - n AS BIGINT) AS start FROM {name}_counts),
{name}_sizes AS (SELECT s, {sizes} FROM {name}_starts),
{name}_ranks AS (SELECT {id_col} AS id, {stratum} AS s,
  row_number() OVER (PARTITION BY {stratum} ORDER BY {sql_key(id_col, seed)}) AS r FROM {source}),
{name} AS (SELECT id, CASE {cases} ELSE {k - 1} END AS fold
  FROM {name}_ranks JOIN {name}_sizes USING (s))"""


def split_sql(
    source: str, stratum: str, key: str, groups: str = "1", test_size: float = 0.2, name: str = "parted", col: str = "side"
) -> str:
    """Test or train side of each row of ``source``, with largest-remainder quotas."""
    return f"""{name}_counts AS (SELECT {groups} AS g, {stratum} AS s, count(*) AS n FROM {source} GROUP BY ALL),
{name}_sizes AS (SELECT g, s, n, CAST(sum(n) OVER (PARTITION BY g) AS BIGINT) AS size FROM {name}_counts),
{name}_shares AS (SELECT *, CAST(ceil(CAST({test_size} AS DOUBLE) * size) AS BIGINT) AS t FROM {name}_sizes),
{name}_whole AS (SELECT *, (n * t) // size AS base, (n * t) % size AS rest FROM {name}_shares),
{name}_quota AS (SELECT g, s, base + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY rest DESC, s)
  <= t - sum(base) OVER (PARTITION BY g) THEN 1 ELSE 0 END AS q FROM {name}_whole),
{name}_ranks AS (SELECT *, {groups} AS g, {stratum} AS s,
  row_number() OVER (PARTITION BY {groups}, {stratum} ORDER BY {key}) AS r FROM {source}),
{name} AS (SELECT {name}_ranks.* EXCLUDE (g, s, r), CASE WHEN r <= q THEN 'test' ELSE 'train' END AS {col}
  FROM {name}_ranks JOIN {name}_quota USING (g, s))"""


def sql_prediction(width: float, *salts) -> str:
    noisy = f"(score + ({sql_unit(sql_key('id', *salts))} - 0.5) * CAST({width} AS DOUBLE))"
    return f"(floor({noisy} * 1000000 + 0.5::DOUBLE) / 1000000)"


OOF_SQL = "oof AS (SELECT id, fold, score, " + ", ".join(
    f"{sql_prediction(w, v)} AS {v}" for v, w in views.VERSIONS.items()
) + " FROM pairs JOIN folds USING (id))"

FOLD_CTES = (PAIRS_SQL, folds_sql("pairs", "score", views.N_FOLDS, views.SEED))
OOF_CTES = (*FOLD_CTES, OOF_SQL)
LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT id, fold, score, '{v}' AS version, {v} AS pred FROM oof" for v in VERSIONS
) + ")"

MATRIX_SQL = "matrix AS (SELECT id, " + ", ".join(
    f"{sql_prediction(w, v, k)} AS {v}_fold_{k}" for v, w in views.VERSIONS.items() for k in FOLDS
) + " FROM (SELECT *, 0.5::DOUBLE AS score FROM test_pairs))"


def sql_pearson(y: str, p: str) -> str:
    return (
        f"CASE WHEN stddev_pop({y}) * stddev_pop({p}) > 0 "
        f"THEN covar_pop({y}, {p}) / (stddev_pop({y}) * stddev_pop({p})) END"
    )
