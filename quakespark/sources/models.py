"""Source models and their logic tree as namespaced XML: written from rows in many files, and read back."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.operators.assembly import numbered

#: The namespaces of the format.
NRML, GML = "http://openquake.org/xmlns/nrml/0.5", "http://www.opengis.net/gml"
TREE_NRML = "http://openquake.org/xmlns/nrml/0.4"
HEAD = f'<?xml version="1.0" encoding="UTF-8"?>\n<nrml xmlns="{NRML}" xmlns:gml="{GML}">\n<sourceModel name="{{}}">'
FOOT = "</sourceModel>\n</nrml>"
CORNER = "array<struct<lon: double, lat: double>>"


def escaped(text: Column) -> Column:
    """Text that may stand in XML, also between quotes."""
    out = text.cast("string")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _attributes(**values: Column | str) -> Column:
    return F.concat(*(part for n, v in values.items() for part in (F.lit(f' {n}="'), escaped(F.lit(v) if isinstance(v, str) else v), F.lit('"'))))


def _element(tag: str, inner: Column, attributes: Column | None = None) -> Column:
    return F.concat(F.lit(f"<{tag}"), F.lit("") if attributes is None else attributes, F.lit(">"), inner, F.lit(f"</{tag}>"))


def _text(tag: str, value: Column) -> Column:
    return _element(tag, value.cast("string"))


def _magnitudes() -> Column:
    """An incremental law without its last zeros, or a truncated one where ``rates`` is null."""
    c = F.col
    last = F.array_max(F.transform("rates", lambda r, i: F.when(r > 0, i + 1).otherwise(0)))
    rates = F.array_join(F.slice("rates", 1, last).cast("array<string>"), " ")
    stepped = _element("incrementalMFD", _text("occurRates", rates), _attributes(minMag=c("m_min"), binWidth=c("width")))
    law = F.concat(F.lit("<truncGutenbergRichterMFD"), _attributes(aValue=c("a"), bValue=c("b"), minMag=c("m_min"), maxMag=c("m_max")), F.lit("/>"))
    return F.when(c("rates").isNotNull(), stepped).otherwise(law)


def _positions(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), " ")


def _common(kind: str, geometry: Column, rest: Column) -> Column:
    c = F.col
    scaling, ratio = _text("magScaleRel", escaped(c("scaling"))), _text("ruptAspectRatio", c("aspect"))
    return _element(kind, F.concat(geometry, scaling, ratio, _magnitudes(), rest), _attributes(id=c("id"), name=c("name"), tectonicRegion=c("region")))


def point_xml() -> Column:
    """A point source: id, name, region, lon, lat, upper, lower, scaling, aspect, the law's columns, planes (array of
    probability, strike, dip, rake) and depths (array of probability, depth)."""
    c = F.col
    place = _element("gml:Point", _text("gml:pos", F.concat_ws(" ", c("lon").cast("string"), c("lat").cast("string"))))
    geometry = _element("pointGeometry", F.concat(place, _text("upperSeismoDepth", c("upper")), _text("lowerSeismoDepth", c("lower"))))
    plane = lambda p: F.concat(F.lit("<nodalPlane"), _attributes(probability=p["probability"], strike=p["strike"], dip=p["dip"], rake=p["rake"]), F.lit("/>"))
    depth = lambda d: F.concat(F.lit("<hypoDepth"), _attributes(probability=d["probability"], depth=d["depth"]), F.lit("/>"))
    rest = F.concat(_element("nodalPlaneDist", F.array_join(F.transform("planes", plane), "")), _element("hypoDepthDist", F.array_join(F.transform("depths", depth), "")))
    return _common("pointSource", geometry, rest)


def simple_fault_xml() -> Column:
    """A simple fault: id, name, region, trace (array of corners), dip, rake, upper, lower, scaling, aspect, the law's columns."""
    c = F.col
    line = _element("gml:LineString", _text("gml:posList", _positions(c("trace"))))
    geometry = _element("simpleFaultGeometry", F.concat(line, _text("dip", c("dip")), _text("upperSeismoDepth", c("upper")), _text("lowerSeismoDepth", c("lower"))))
    return _common("simpleFaultSource", geometry, _text("rake", c("rake")))


def complex_fault_xml() -> Column:
    """A complex fault: id, name, region, edges (from the top down: arrays of lon, lat, depth), rake, scaling, aspect, the law's columns."""
    c = F.col
    places = lambda e: F.array_join(F.transform(e, lambda p: F.concat_ws(" ", *(p[n].cast("string") for n in ("lon", "lat", "depth")))), " ")
    tag = lambda i: F.when(i == 0, "faultTopEdge").when(i == F.size("edges") - 1, "faultBottomEdge").otherwise("intermediateEdge")
    edge = lambda e, i: F.concat(F.lit("<"), tag(i), F.lit("><gml:LineString><gml:posList>"), places(e), F.lit("</gml:posList></gml:LineString></"), tag(i), F.lit(">"))
    return _common("complexFaultSource", _element("complexFaultGeometry", F.array_join(F.transform("edges", edge), "")), _text("rake", c("rake")))


def usable(sources: DataFrame) -> DataFrame:
    """Sources whose law has a positive rate and whose depths, if they have any, are in order; the others have no place in a model."""
    positive = F.col("rates").isNull() | F.exists("rates", lambda r: r > 0)
    depths = (F.col("upper") < F.col("lower")) if {"upper", "lower"} <= set(sources.columns) else F.lit(True)
    return sources.where(F.coalesce(positive & depths, F.lit(False)))


def write_source_model(sources: DataFrame, xml: Column, path: str, name: str, per_file: int = 20_000) -> list[str]:
    """Writes sources (with a unique ``id``) as XML documents of at most ``per_file`` of them, and returns the files' paths in order.

    Each document is a task's stream of lines, from its head to its foot; a model of any size is many of them.
    """
    order = numbered(sources.withColumn("__xml", xml).select("id", "__xml"), [F.col("id")], "__nth")
    rows = order.select(F.floor((F.col("__nth") - 1) / per_file).alias("file"), F.col("__nth").alias("line"), F.col("__xml").alias("value"))
    files = rows.select("file").distinct()
    title = name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    frame = lambda at, text: files.select("file", F.lit(at).cast("long").alias("line"), F.lit(text).alias("value"))
    whole = rows.union(frame(0, HEAD.format(title))).union(frame((1 << 62), FOOT))
    whole.repartition("file").sortWithinPartitions("file", "line").select("file", "value").write.partitionBy("file").text(path)
    spark = sources.sparkSession
    written = spark.read.text(path).select("file", F.input_file_name().alias("path")).distinct().orderBy("file").collect()  # a row a file
    return [r["path"] for r in written]


def branch_product(components: list[DataFrame]) -> DataFrame:
    """(branch_id, files, weight) of all combinations of the components' branches (branch_id, files, weight), a few rows each.

    Ids are joined by "_", without empty ones; an id that is empty throughout is "b1". Weights multiply, files follow one another.
    """
    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.crossJoin(F.broadcast(b.select(F.col("branch_id").alias("i"), F.col("files").alias("f"), F.col("weight").alias("w"))))
        return both.select(F.concat_ws("_", F.nullif("branch_id", F.lit("")), F.nullif("i", F.lit(""))).alias("branch_id"), F.concat("files", "f").alias("files"), (F.col("weight") * F.col("w")).alias("weight"))

    whole = reduce(joined, (c.select("branch_id", "files", "weight") for c in components))
    return whole.withColumn("branch_id", F.when(F.col("branch_id") == "", "b1").otherwise(F.col("branch_id")))


def write_logic_tree(branches: DataFrame, path: str, name: str = "lt", kind: str = "sourceModel") -> str:
    """Writes branches (branch_id, files, weight) as one logic-tree document, and returns its path; raises if the weights don't add up to 1."""
    total = branches.agg(F.sum("weight")).first()[0]
    if total is None or not math.isclose(total, 1.0, abs_tol=1e-6):
        raise ValueError(f"the weights add up to {total}")
    branch = F.concat(
        F.lit("<logicTreeBranch"), _attributes(branchID=F.col("branch_id")), F.lit("><uncertaintyModel>"), escaped(F.array_join("files", " ")), F.lit("</uncertaintyModel><uncertaintyWeight>"),
        F.col("weight").cast("string"), F.lit("</uncertaintyWeight></logicTreeBranch>"),
    )
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<nrml xmlns:gml="{GML}" xmlns="{TREE_NRML}">\n<logicTree logicTreeID="{name}"><logicTreeBranchingLevel branchingLevelID="bl1"><logicTreeBranchSet uncertaintyType="{kind}" branchSetID="bs1">'
    foot = "</logicTreeBranchSet></logicTreeBranchingLevel></logicTree>\n</nrml>"
    spark = branches.sparkSession
    ends = spark.createDataFrame([(0, "", head), (2, "", foot)], "part int, id string, value string")
    rows = branches.select(F.lit(1).alias("part"), F.col("branch_id").alias("id"), branch.alias("value")).union(ends)
    rows.repartition(1).sortWithinPartitions("part", "id").select("value").write.text(path)  # a tree is one document
    return spark.read.text(path).select(F.input_file_name()).first()[0]


_LAW = "incrementalMFD struct<_minMag: double, _binWidth: double, occurRates: string>, truncGutenbergRichterMFD struct<_aValue: double, _bValue: double, _minMag: double, _maxMag: double>"
_LINE = "struct<LineString: struct<posList: string>>"
_HEAD = f"_id string, _name string, _tectonicRegion string, magScaleRel string, ruptAspectRatio double, rake double, {_LAW}"
SCHEMAS = {
    "pointSource": f"{_HEAD}, pointGeometry struct<Point: struct<pos: string>, upperSeismoDepth: double, lowerSeismoDepth: double>, "
    "nodalPlaneDist struct<nodalPlane: array<struct<_probability: double, _strike: double, _dip: double, _rake: double>>>, hypoDepthDist struct<hypoDepth: array<struct<_probability: double, _depth: double>>>",
    "simpleFaultSource": f"{_HEAD}, simpleFaultGeometry struct<LineString: struct<posList: string>, dip: double, upperSeismoDepth: double, lowerSeismoDepth: double>",
    "complexFaultSource": f"{_HEAD}, complexFaultGeometry struct<faultTopEdge: {_LINE}, intermediateEdge: array<{_LINE}>, faultBottomEdge: {_LINE}>",
}


def numbers(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def grouped(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size``; what is left over at the end goes."""
    n = F.floor(F.size(values) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * size + 1, F.lit(size))))


def read_sources(spark: SparkSession, path: str, kind: str = "pointSource") -> DataFrame:
    """The sources of one kind: id, name, region, scaling, aspect, rake, the law (rates, width, a, b, m_min, m_max) and their geometry.

    Points have lon, lat, upper, lower, planes and depths; simple faults trace, dip, upper and lower; complex faults edges.
    """
    raw = spark.read.format("xml").options(rowTag=kind, attributePrefix="_", ignoreNamespace=True).schema(SCHEMAS[kind]).load(path)
    step, law = "incrementalMFD", "truncGutenbergRichterMFD"
    common = [
        F.col("_id").alias("id"), F.col("_name").alias("name"), F.col("_tectonicRegion").alias("region"), F.trim("magScaleRel").alias("scaling"), F.col("ruptAspectRatio").alias("aspect"), "rake",
        numbers(F.col(f"{step}.occurRates")).alias("rates"), F.col(f"{step}._binWidth").alias("width"), F.col(f"{law}._aValue").alias("a"), F.col(f"{law}._bValue").alias("b"),
        F.coalesce(f"{step}._minMag", f"{law}._minMag").alias("m_min"), F.col(f"{law}._maxMag").alias("m_max"),
    ]
    corners = lambda t: F.transform(grouped(numbers(t), 2), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    nodes = lambda t: F.transform(grouped(numbers(t), 3), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), p[2].alias("depth")))
    renamed = lambda array, fields: F.transform(array, lambda x: F.struct(*(x[f"_{f}"].alias(f) for f in fields)))
    if kind == "pointSource":
        g, at = "pointGeometry", numbers(F.col("pointGeometry.Point.pos"))
        own = [F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), F.col(f"{g}.upperSeismoDepth").alias("upper"), F.col(f"{g}.lowerSeismoDepth").alias("lower"),
               renamed("nodalPlaneDist.nodalPlane", ("probability", "strike", "dip", "rake")).alias("planes"), renamed("hypoDepthDist.hypoDepth", ("probability", "depth")).alias("depths")]
    elif kind == "simpleFaultSource":
        g = "simpleFaultGeometry"
        own = [corners(F.col(f"{g}.LineString.posList")).alias("trace"), F.col(f"{g}.dip").alias("dip"), F.col(f"{g}.upperSeismoDepth").alias("upper"), F.col(f"{g}.lowerSeismoDepth").alias("lower")]
    else:
        g = "complexFaultGeometry"
        inner = F.coalesce(F.transform(f"{g}.intermediateEdge", lambda e: nodes(e["LineString"]["posList"])), F.array().cast("array<array<struct<lon: double, lat: double, depth: double>>>"))
        own = [F.concat(F.array(nodes(F.col(f"{g}.faultTopEdge.LineString.posList"))), inner, F.array(nodes(F.col(f"{g}.faultBottomEdge.LineString.posList")))).alias("edges")]
    return raw.select(*common, *own)


def rate_differences(grid: DataFrame, sources: DataFrame) -> DataFrame:
    """(bin, grid, sources, difference): summed rates by bin of a grid (bin, rate) and of sources with ``rates`` from the same first bin on."""
    c = F.col
    a = grid.groupBy("bin").agg(F.sum("rate").alias("grid"))
    b = sources.select(F.posexplode("rates").alias("bin", "r")).groupBy("bin").agg(F.sum("r").alias("sources"))
    return a.join(b, "bin", "full").select("bin", F.coalesce("grid", F.lit(0.0)).alias("grid"), F.coalesce("sources", F.lit(0.0)).alias("sources")).withColumn("difference", c("sources") - c("grid"))
