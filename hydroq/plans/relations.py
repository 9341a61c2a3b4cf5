"""Joins, sorts, limits and set operators over the measurement view."""

from pyspark.sql import functions as F

from hydroq import schema as S
from hydroq.functions import labels as L
from hydroq.operators import dimensions, filters, integrity, ordered
from hydroq.plans.catalog import obs, query, records
from hydroq.sources.test_tables import table

_Q = "MeasurementQualifier"
_DEF = "('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS')"


@query("d01_left_join_counts", f"SELECT StationNumber, count(*) AS total, count(*) FILTER ({_Q} IN {_DEF}) AS flagged FROM obs GROUP BY 1")
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", _Q)
    total = rows.groupBy("StationNumber").agg(records("total"))
    flagged = rows.where(F.col(_Q).isin(S.UNRELIABLE_CODES)).groupBy("StationNumber").agg(records("flagged"))
    return total.join(flagged, "StationNumber", "left").na.fill(0, ["flagged"])


@query("d02_outer_join_counts", "SELECT VmvCode, count(*) FILTER (MeasurementFlag = 'L') AS low, count(*) FILTER (MeasurementFlag = 'G') AS estimated FROM obs WHERE MeasurementFlag IS NOT NULL GROUP BY 1")
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "MeasurementFlag")
    sides = [rows.where(F.col("MeasurementFlag") == f).groupBy("VmvCode").agg(records(n)) for f, n in (("L", "low"), ("G", "estimated"))]
    return sides[0].join(sides[1], "VmvCode", "full_outer").na.fill(0, ["low", "estimated"])


@query(
    "d03_left_merge",
    """SELECT a.VmvCode, a.units, b.name FROM (SELECT VmvCode, count(DISTINCT UnitCode) AS units FROM obs GROUP BY 1) a LEFT JOIN (SELECT VmvCode, arg_min(VariableName,row_key) AS name FROM obs GROUP BY 1) b USING (VmvCode)""",
)
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "UnitCode", "VariableName", "row_key")
    counts = rows.groupBy("VmvCode").agg(F.countDistinct("UnitCode").alias("units"))
    names = dimensions.variable_map(rows).withColumnRenamed("VariableName", "name")
    return counts.join(names, "VmvCode", "left")


@query(
    "d04_lookup_join",
    """SELECT StationNumber, coalesce(n.name, o.VmvCode::VARCHAR) AS label, count(*) AS records FROM obs o LEFT JOIN (SELECT VmvCode, arg_min(VariableName,row_key) AS name FROM obs GROUP BY 1) n USING (VmvCode) GROUP BY 1,2""",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VmvCode", "VariableName", "row_key")
    # counted per code first, so the lookup meets one row per station and code
    counts = rows.groupBy("StationNumber", "VmvCode").agg(records())
    names = dimensions.variable_map(rows)
    return counts.join(names, "VmvCode", "left").groupBy("StationNumber", F.coalesce("VariableName", F.col("VmvCode").cast("string")).alias("label")).agg(F.sum("records").alias("records"))


@query("d05_one_pass_lookups", 'SELECT StationNumber, count(DISTINCT Station) AS "UniqueNames", count(DISTINCT ProjectNumber) AS "ProjectCount", count(*) AS "RecordCount" FROM obs GROUP BY 1')
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "Station", "ProjectNumber", "SampleNumber", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees")
    return integrity.cardinality_report(rows).select("StationNumber", "UniqueNames", "ProjectCount", "RecordCount")


@query("d06_semi_join", "SELECT LabCode, count(*) AS records FROM obs WHERE VmvCode IN (SELECT VmvCode FROM obs WHERE UnitCode = 'ug/L') GROUP BY 1")
def _(spark, sf):
    rows = obs(spark, sf, "VmvCode", "UnitCode", "LabCode")
    return filters.rows_of(rows, rows.where("UnitCode = 'ug/L'").select("VmvCode").distinct(), ["VmvCode"]).groupBy("LabCode").agg(records())


@query(
    "d07_composite_key_flag",
    """SELECT flagged, count(*) AS records FROM (SELECT (StationNumber, year(SampleDateTime)) IN (SELECT StationNumber, year(SampleDateTime) FROM obs GROUP BY 1,2 HAVING count(*) < 60) AS flagged FROM obs) GROUP BY 1""",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "SampleDateTime").withColumn("Year", F.year("SampleDateTime"))
    # the flag is the same for all rows of a pair, so it is decided on the counts
    pairs = rows.groupBy("StationNumber", "Year").agg(records("n"))
    return pairs.groupBy((F.col("n") < 60).alias("flagged")).agg(F.sum("n").alias("records"))


@query(
    "d09_star_join",
    """SELECT s_name AS Station, n_name AS basin, count(l_orderkey) AS records, count(DISTINCT l_partkey % 91) AS variables FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1,2""",
    raw_sql=True,
)
def _(spark, sf):
    stations = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    facts = obs(spark, sf, "StationNumber", "VmvCode").groupBy("StationNumber").agg(records(), F.countDistinct("VmvCode").alias("variables"))
    keyed = stations.selectExpr("concat('AB', lpad(CAST(s_suppkey AS STRING),8,'0')) AS StationNumber", "s_name AS Station", "n_name AS basin")
    return keyed.join(facts, "StationNumber", "left").na.fill(0).select("Station", "basin", "records", "variables")


@query("d10_dimension_attach", "SELECT RiverBasinCode, StationNumber, arg_min(Station,row_key) AS Station, count(*) AS records FROM obs GROUP BY 1,2")
def _(spark, sf):
    rows = obs(spark, sf, "RiverBasinCode", "StationNumber", "Station", "row_key", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees")
    counts = rows.groupBy("RiverBasinCode", "StationNumber").agg(records())
    return counts.join(dimensions.stations(rows).select("StationNumber", "Station"), "StationNumber")


@query("h01_sorted_report", "SELECT VmvCode, UnitCode, count(*) AS records FROM obs GROUP BY 1,2 ORDER BY VmvCode, records DESC")
def _(spark, sf):
    return obs(spark, sf, "VmvCode", "UnitCode").groupBy("VmvCode", "UnitCode").agg(records()).orderBy("VmvCode", F.desc("records"), "UnitCode")


@query("h02_top_k", "SELECT SampleNumber, count(*) AS records FROM obs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return obs(spark, sf, "SampleNumber").groupBy("SampleNumber").agg(records()).orderBy(F.desc("records"), "SampleNumber").limit(20)


@query(
    "h03_top_k_per_group",
    "SELECT StationNumber, VmvCode, records FROM (SELECT *, row_number() OVER (PARTITION BY StationNumber ORDER BY records DESC, VmvCode) rn FROM (SELECT StationNumber, VmvCode, count(*) AS records FROM obs GROUP BY 1,2)) WHERE rn <= 3",
)
def _(spark, sf):
    counts = obs(spark, sf, "StationNumber", "VmvCode").groupBy("StationNumber", "VmvCode").agg(records())
    return ordered.top_k(counts, ["StationNumber"], [F.desc("records"), F.asc("VmvCode")], 3)


@query(
    "h04_ordered_category",
    """SELECT level_order, CASE level_order WHEN 0 THEN 'Minimal (<3 vars)' WHEN 1 THEN 'Basic (3-7 vars)' WHEN 2 THEN 'Moderate (7-12 vars)' ELSE 'Comprehensive (12+ vars)' END AS level, samples FROM
    (SELECT CASE WHEN v <= 3 THEN 0 WHEN v <= 7 THEN 1 WHEN v <= 12 THEN 2 ELSE 3 END AS level_order, count(*) AS samples FROM (SELECT SampleNumber, count(DISTINCT VariableName) v FROM obs GROUP BY 1) GROUP BY 1)""",
)
def _(spark, sf):
    per = obs(spark, sf, "SampleNumber", "VariableName").groupBy("SampleNumber").agg(F.countDistinct("VariableName").alias("v"))
    return per.groupBy(L.coverage_order("v").alias("level_order"), L.coverage_level("v").alias("level")).agg(records("samples")).orderBy("level_order")


@query("i01_first_per_key", "SELECT VmvCode, arg_min(StationNumber, row_key) AS StationNumber, arg_min(SampleNumber, row_key) AS SampleNumber FROM obs GROUP BY 1")
def _(spark, sf):
    first = F.min_by(F.struct("StationNumber", "SampleNumber"), "row_key").alias("f")
    return obs(spark, sf, "VmvCode", "StationNumber", "SampleNumber", "row_key").groupBy("VmvCode").agg(first).select("VmvCode", "f.*")


@query("i02_distinct_rows", "SELECT DISTINCT StationNumber, LatitudeDecimalDegrees, LongitudeDecimalDegrees, ProjectNumber FROM obs")
def _(spark, sf):
    return obs(spark, sf, "StationNumber", "LatitudeDecimalDegrees", "LongitudeDecimalDegrees", "ProjectNumber").distinct()


@query("i03_unique_values", "SELECT DISTINCT VariableName FROM obs ORDER BY 1")
def _(spark, sf):
    return dimensions.distinct_sorted(obs(spark, sf, "VariableName"), "VariableName")


@query("i04_union_all", "SELECT part, count(*) AS records FROM (SELECT 'early' AS part FROM obs WHERE year(SampleDateTime) < 1998 UNION ALL SELECT 'late' FROM obs WHERE year(SampleDateTime) >= 1998 UNION ALL SELECT 'early' FROM obs WHERE year(SampleDateTime) = 2000) GROUP BY 1")
def _(spark, sf):
    rows = obs(spark, sf, "SampleDateTime").withColumn("y", F.year("SampleDateTime"))
    early, late, again = (rows.where(c).select(F.lit(p).alias("part"), "y") for c, p in (("y < 1998", "early"), ("y >= 1998", "late"), ("y = 2000", "early")))
    return early.unionByName(late).unionByName(again).groupBy("part").agg(records())


@query("i05_code_set_union", f"SELECT {_Q}, count(*) AS records FROM obs WHERE {_Q} IN ('SUS','RER|SUS','HT|RER|SUS','HT|SUS','DR|SUS','HT','DR','SPNF','OBS','FSE','RER','EST') GROUP BY 1")
def _(spark, sf):
    codes = sorted(set(S.UNRELIABLE_CODES) | set(S.ACCEPTABLE_CODES))
    return obs(spark, sf, _Q).where(F.col(_Q).isin(codes)).groupBy(_Q).agg(records())


@query("i06_key_difference", "SELECT DISTINCT StationNumber FROM obs EXCEPT SELECT StationNumber FROM obs WHERE VmvCode = 6 AND year(SampleDateTime) = 1997")
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "VmvCode", "SampleDateTime")
    have = rows.where("VmvCode = 6 and year(SampleDateTime) = 1997").select("StationNumber").distinct()
    return rows.select("StationNumber").distinct().join(have, "StationNumber", "left_anti")


@query(
    "i08_grouping_sets",
    """SELECT coalesce(StationNumber,'all') AS station, coalesce(y,'all') AS year, count(*) AS records FROM (SELECT StationNumber, year(SampleDateTime)::VARCHAR AS y FROM obs) GROUP BY ROLLUP (StationNumber, y)""",
)
def _(spark, sf):
    rows = obs(spark, sf, "StationNumber", "SampleDateTime").select(F.col("StationNumber").alias("station"), F.year("SampleDateTime").cast("string").alias("year"))
    return rows.rollup("station", "year").agg(records()).na.fill("all", ["station", "year"])
