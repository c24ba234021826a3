"""Neighbourhood queries on a 2-D map: who lies within a radius of a point, and of which class.

The radius join never pairs a point with everything around it. Reference points are counted per
small tile (an eighth of the radius wide by default) with the tile's bounding box; tiles wholly inside the
ball contribute their class counts, tiles wholly outside are dropped, and only tiles cut by the
circle are looked up point by point. Copies of a point are one weighted point.

An index can be stored by region. Few query points then read the regions around them only, and the stored side is neither
shuffled nor built again; many are joined as without storing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.session import written

# relative slack around the radius inside which a tile is checked point by point
_SLACK = 1e-9
# distinct points of one cut tile that share a join key
_POINTS_PER_KEY = 4096
_KEY = ["cx", "cy", "sx", "sy"]
# regions of a stored index: blocks of cells, dealt over folders
_BLOCK, REGIONS = 8, 64
# distinct query points that are sent to the stored side: they meet at most 9 refine^2 tiles each, 35 MB in all
FEW_SPOTS = 1000


def _tile(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def _region() -> Column:
    block = [F.floor(F.col(c) / F.lit(_BLOCK)) for c in ("cx", "cy")]
    return F.pmod(F.xxhash64(*block), F.lit(REGIONS)).cast("int")


def _square(x: Column) -> Column:
    return x * x


@dataclass
class NeighbourIndex:
    """Training points prepared for ball queries of one radius: weighted points by tile, and the tiles.

    Both are written once: they are used several times in every query, and by every later query.
    """

    eps: float
    points: DataFrame
    tiles: DataFrame | None
    stored: bool = False

    def save(self, path: str) -> None:
        """Points and tiles by region, in the order of cells; crowded regions are spread over several files."""
        if self.tiles is None:
            raise ValueError("a radius of 0 has no regions to store")
        spark = self.points.sparkSession
        for name, table in (("points", self.points), ("tiles", self.tiles)):
            placed = table.withColumn("region", _region())
            placed.repartitionByRange("region", "cx", "cy").sortWithinPartitions("region", "cx", "cy").write.mode(
                "overwrite").partitionBy("region").parquet(f"{path}/{name}")
        spark.createDataFrame([(self.eps,)], "eps double").write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourIndex:
        eps = spark.read.parquet(f"{path}/about").first().eps
        point = "tx double, ty double, label int, n long, cx long, cy long, sx long, sy long, region int"
        tile = ("cx long, cy long, sx long, sy long, counts array<struct<label: int, n: long>>, x0 double, x1 double, y0 double, "
                "y1 double, parts int, region int")
        return cls(eps, spark.read.schema(point).parquet(f"{path}/points"), spark.read.schema(tile).parquet(f"{path}/tiles"), True)

    @classmethod
    def build(cls, train: DataFrame, eps: float, x: str = "x", y: str = "y", label: str = "label",
              refine: int = 8) -> NeighbourIndex:
        if eps < 0:
            raise ValueError("the radius must not be negative")
        points = (
            _spots(train, x, y, "tx", "ty", F.col(label).cast("int").alias("label"))
            .groupBy("tx", "ty", "label").agg(F.count("*").alias("n"))
        )
        if eps == 0:
            return cls(0.0, written(points), None)
        cell = eps * (1 + _SLACK)  # a point at distance exactly eps is never two cells away
        fine = cell / refine
        points = written(points.withColumns({
            "cx": _tile(F.col("tx"), cell), "cy": _tile(F.col("ty"), cell),
            "sx": _tile(F.col("tx"), fine), "sy": _tile(F.col("ty"), fine),
        }))
        tiles = (
            points.groupBy(*_KEY, "label")
            .agg(
                F.sum("n").alias("n"), F.count("*").alias("points"),
                F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"),
            )
            .groupBy(*_KEY)
            .agg(
                F.collect_list(F.struct("label", "n")).alias("counts"),  # one entry per class
                F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
                F.ceil(F.sum("points") / F.lit(_POINTS_PER_KEY)).cast("int").alias("parts"),
            )
        )
        return cls(float(eps), points, written(tiles))


    def spot_counts(self, queries: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """(qx, qy, label, n) for every distinct query position: copies are asked once."""
        spots = _spots(queries, x, y, "qx", "qy").distinct()
        if self.tiles is None:
            same = (F.col("qx") == F.col("tx")) & (F.col("qy") == F.col("ty"))
            return spots.join(self.points, same).select("qx", "qy", "label", "n")
        return self._ball_counts(spots)

    def label_counts(self, queries: DataFrame, id_col: str = "flow_id", x: str = "x", y: str = "y") -> DataFrame:
        """(id, label, n): training points of each label within the closed ball around every query point."""
        asked = _spots(queries, x, y, "qx", "qy", F.col(id_col))
        return asked.join(self.spot_counts(queries, x, y), ["qx", "qy"]).select(id_col, "label", "n")

    def neighbourhood(self, queries: DataFrame, x: str = "x", y: str = "y",
                      labels: list[int] | None = None) -> DataFrame:
        """Every query row with its number of neighbours, density, predicted label and, for the given
        ``labels``, one probability column each.

        The prediction is the most frequent label, ties going to the smaller one; an empty ball predicts -1.
        Counts are folded per position first, so the query rows meet one row each.
        """
        n, size = F.col("n"), F.col("neighbours")
        folded = self.spot_counts(queries, x, y).groupBy("qx", "qy").agg(
            F.sum("n").alias("neighbours"),
            F.max_by("label", F.struct(n, -F.col("label"))).cast("int").alias("predicted"),
            *[F.sum(F.when(F.col("label") == c, n).otherwise(0)).alias(f"_n{c}") for c in labels or []],
        )
        out = queries.withColumns({"qx": F.col(x) + 0.0, "qy": F.col(y) + 0.0}).join(folded, ["qx", "qy"], "left")
        out = out.withColumns({
            "neighbours": F.coalesce("neighbours", F.lit(0)).cast("long"),
            "predicted": F.coalesce("predicted", F.lit(-1)),
        })
        extra = {
            "density": size / F.lit(self.eps) if self.eps else F.lit(None).cast("double"),
            "outlierness": F.when(size > 0, F.lit(self.eps) / size),
            **{f"p_{c}": F.coalesce(F.col(f"_n{c}") / size, F.lit(0.0)) for c in labels or []},
        }
        return out.withColumns(extra).drop("qx", "qy", *[f"_n{c}" for c in labels or []])

    def _ball_counts(self, spots: DataFrame) -> DataFrame:
        if self.stored:
            # a bounded look at the query points; the answer does not depend on which way is taken
            seen = spots.limit(FEW_SPOTS + 1).collect()
            if len(seen) <= FEW_SPOTS:
                return self._few_counts(spots.sparkSession.createDataFrame(seen, "qx double, qy double"))
        met = self._met(self._around(spots).join(self.tiles, ["cx", "cy"]))
        # tiles with many points are split over several keys; the query row is repeated once per key
        split = self.points.join(self.tiles.select(*_KEY, "parts"), _KEY).withColumn(
            "part", F.pmod(F.xxhash64("tx", "ty", "label"), F.col("parts")).cast("int")
        )
        cut = met.where(~F.col("inside")).select(
            "qx", "qy", *_KEY, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        )
        return self._counted(met, cut.join(split.select(*_KEY, "part", "tx", "ty", "label", "n"), [*_KEY, "part"]))

    def _few_counts(self, spots: DataFrame) -> DataFrame:
        """The query points go to the regions around them; nothing of the stored side moves."""
        around = self._around(spots)
        regions = [r.region for r in around.select(_region().alias("region")).distinct().collect()]  # at most REGIONS
        near = F.col("region").isin(regions)
        met = self._met(self.tiles.where(near).join(F.broadcast(around), ["cx", "cy"]))
        cut = met.where(~F.col("inside")).select("qx", "qy", *_KEY)
        return self._counted(met, self.points.where(near).join(F.broadcast(cut), _KEY))

    def _around(self, spots: DataFrame) -> DataFrame:
        """Every spot with each of the nine cells that its ball may reach."""
        cell, steps = self.eps * (1 + _SLACK), F.array(*[F.lit(d) for d in (-1, 0, 1)])
        return spots.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(
            "qx", "qy", (_tile(F.col("qx"), cell) + F.col("dx")).alias("cx"), (_tile(F.col("qy"), cell) + F.col("dy")).alias("cy"))

    def _met(self, pairs: DataFrame) -> DataFrame:
        """Pairs of a spot and a tile that its ball touches, and whether the tile is inside."""
        qx, qy, square = F.col("qx"), F.col("qy"), self.eps * self.eps
        near = _square(F.greatest(F.col("x0") - qx, qx - F.col("x1"), F.lit(0.0))) + _square(
            F.greatest(F.col("y0") - qy, qy - F.col("y1"), F.lit(0.0))
        )
        far = _square(F.greatest(F.abs(qx - F.col("x0")), F.abs(qx - F.col("x1")))) + _square(
            F.greatest(F.abs(qy - F.col("y0")), F.abs(qy - F.col("y1")))
        )
        return pairs.where(near <= square * (1 + _SLACK)).withColumn("inside", far <= square * (1 - _SLACK))

    def _counted(self, met: DataFrame, checked: DataFrame) -> DataFrame:
        """Counts of whole tiles and of the single points of cut ones."""
        distance = _square(F.col("tx") - F.col("qx")) + _square(F.col("ty") - F.col("qy"))
        found = checked.where(distance <= self.eps * self.eps).select("qx", "qy", "label", "n")
        whole = met.where("inside").select("qx", "qy", F.inline("counts"))
        return whole.unionByName(found).groupBy("qx", "qy", "label").agg(F.sum("n").alias("n"))


def _spots(df: DataFrame, x: str, y: str, as_x: str, as_y: str, *keep: Column) -> DataFrame:
    """Coordinates without nulls and NaN; adding 0.0 folds -0.0 into 0.0, so equal coordinates are equal keys."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return df.where(known).select((F.col(x) + 0.0).alias(as_x), (F.col(y) + 0.0).alias(as_y), *keep)


def eps_label_counts(queries: DataFrame, train: DataFrame, eps: float, id_col: str = "flow_id", x: str = "x",
                     y: str = "y", label: str = "label", refine: int = 8) -> DataFrame:
    """Ball counts for one table of queries."""
    return NeighbourIndex.build(train, eps, x, y, label, refine).label_counts(queries, id_col, x, y)


def neighbour_histogram(counts: DataFrame, id_col: str = "flow_id") -> DataFrame:
    """(id, label, n, probability): share of each label inside the ball."""
    totals = counts.groupBy(id_col).agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("label", "n")).alias("rows")  # one entry per class
    )
    return totals.select(id_col, "total", F.inline("rows")).select(
        id_col, "label", "n", (F.col("n") / F.col("total")).alias("probability")
    )


class EpsNeighbourClassifier:
    """Class probabilities of a 2-D point from the training points around it."""

    def __init__(self, id_col: str = "flow_id", x: str = "x", y: str = "y", label: str = "category"):
        self.id_col, self.x, self.y, self.label = id_col, x, y, label

    def fit(self, train: DataFrame) -> EpsNeighbourModel:
        for column in (self.x, self.y, self.label):
            if column not in train.columns:
                raise ValueError(f"training data has no column {column!r}")
        return EpsNeighbourModel(self, train.select(self.x, self.y, self.label))


class EpsNeighbourModel:
    def __init__(self, spec: EpsNeighbourClassifier, train: DataFrame | None):
        self.spec, self.train = spec, train
        self._prepared: dict[float, NeighbourIndex] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, spec: EpsNeighbourClassifier) -> EpsNeighbourModel:
        """A model of the one radius that ``store`` wrote to the path."""
        index = NeighbourIndex.load(spark, path)
        model = cls(spec, None)
        model._prepared[index.eps] = index
        return model

    def store(self, eps: float, path: str) -> EpsNeighbourModel:
        """Write the index of a radius by region, and use it from there."""
        self._index(eps).save(path)
        return self.open(self._index(eps).points.sparkSession, path, self.spec)

    def has(self, eps: float) -> bool:
        return eps in self._prepared

    def prepare(self, eps: float) -> EpsNeighbourModel:
        """Build the index of a radius now; later calls with it only pay for their queries."""
        s = self.spec
        if eps not in self._prepared:
            if self.train is None:
                raise ValueError(f"the stored index has the radius {[*self._prepared]}, not {eps}")
            self._prepared[eps] = NeighbourIndex.build(self.train, eps, s.x, s.y, s.label)
        return self

    def _index(self, eps: float) -> NeighbourIndex:
        return self.prepare(eps)._prepared[eps]

    def predict_proba(self, points: DataFrame, eps: float = 0.05) -> DataFrame:
        """(id, label, n, probability); labels absent from the ball have no row."""
        s = self.spec
        return neighbour_histogram(self._index(eps).label_counts(points, s.id_col, s.x, s.y), s.id_col)

    def explain(self, points: DataFrame, eps: float = 0.05, labels: list[int] | None = None) -> DataFrame:
        return self._index(eps).neighbourhood(points, self.spec.x, self.spec.y, labels)

    def predict(self, points: DataFrame, eps: float = 0.05) -> DataFrame:
        return self.explain(points, eps).select(self.spec.id_col, "predicted")
