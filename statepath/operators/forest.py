"""Forests, trees and k-means over step rows, by MLlib."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statepath.operators.prepare import is_valid, skip_invalid
from statepath.storage import materialize

FOREST_COLUMNS = ("_features", "_raw", "_probability", "_prediction", "_class")

# A model keeps its classes on the driver and statistics of each in every node.
MOST_CLASSES = 10_000

# Rows of one class are ordered by a hash; a slice has its first 12 bits.
_SLICE_SHIFT = 52


def assemble(rows: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Numeric columns as one vector; rows with a null or NaN input are left out."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="skip")
    return assembler.transform(rows)


def initial_states(steps: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """CLUSTER from k-means of RISK, numbered by ascending centre; kept if given.

    RISK has few distinct values, so k-means runs on the weighted values after
    one counting pass, and the nearest centre of a row is found by comparing RISK
    with the midpoints between centres.
    """
    if "CLUSTER" in steps.columns:
        return steps.withColumn("CLUSTER", F.col("CLUSTER").cast("int"))
    known = skip_invalid(steps, ["RISK"])
    weighted = materialize(
        known.groupBy(F.col("RISK").cast("double").alias("RISK")).agg(
            F.count(F.lit(1)).cast("double").alias("weight")
        )
    )
    kmeans = KMeans(k=k, seed=seed, featuresCol="_risk", weightCol="weight")
    model = kmeans.fit(assemble(weighted, ["RISK"], "_risk"))
    centres = sorted(float(c[0]) for c in model.clusterCenters())
    cluster = F.lit(0)
    for low, high in zip(centres, centres[1:]):
        cluster = cluster + (F.col("RISK") > F.lit((low + high) / 2)).cast("int")
    return known.withColumn("CLUSTER", cluster)


def forest_fit(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = 100,
    depth: int = 10,
    seed: int = 0,
) -> PipelineModel:
    """A random forest over the rows whose label and features are all known.

    Labels are any 32-bit integers; the model keeps those that occur (``class_list``).
    """
    known = skip_invalid(rows, [*features, label])
    classes = _classes(known, label)
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"),
        RandomForestClassifier(
            featuresCol="_features",
            labelCol="_label",
            rawPredictionCol="_raw",
            probabilityCol="_probability",
            predictionCol="_prediction",
            numTrees=trees,
            maxDepth=depth,
            seed=seed,
        ),
        _dictionary(classes),
    ]
    fitted = Pipeline(stages=stages).fit(_coded(known, features, label, classes))
    # a copy has no training summary, whose session tasks cannot serialise once it observes
    return PipelineModel([stage.copy() for stage in fitted.stages])


def _classes(rows: DataFrame, label: str) -> list[int]:
    """The sorted labels that occur."""
    whole = (F.col(label).cast("double") == F.col(label).cast("int")).alias("whole")
    found = (
        rows.select(F.col(label).cast("int").alias("class"), whole)
        .distinct()
        .limit(MOST_CLASSES + 1)
        .collect()
    )
    if not found:
        raise ValueError(f"no row has a known {label} and known features")
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    if not all(r.whole for r in found):
        raise ValueError(f"{label} has values that are not whole numbers")
    return sorted({r["class"] for r in found})


def _dictionary(classes: Sequence[int]) -> IndexToString:
    """The last stage of a model: from the codes it predicts back to labels."""
    return IndexToString(
        inputCol="_prediction", outputCol="_class", labels=[str(c) for c in classes]
    )


def _coded(
    rows: DataFrame, features: Sequence[str], label: str, classes: Sequence[int]
) -> DataFrame:
    """The features and ``_label``, the place of the label in the list of classes."""
    named = rows.select(*features, F.col(label).cast("int").alias("_of"))
    code = F.col("_of")
    if list(classes) != list(range(len(classes))):
        codes = rows.sparkSession.createDataFrame(
            list(enumerate(classes)), "_code int, _listed int"
        )
        named = named.join(F.broadcast(codes), F.col("_of") == F.col("_listed"))
        code = F.col("_code")
    # told the number of classes, as otherwise 100 are the most; one class is not accepted
    attribute = {"name": "_label", "type": "nominal", "num_vals": max(2, len(classes))}
    return named.select(
        *features, code.cast("double").alias("_label", metadata={"ml_attr": attribute})
    )


def class_list(model: PipelineModel) -> list[int]:
    """The sorted labels that the model was fitted on."""
    return [int(c) for c in model.stages[-1].getLabels()]


def class_count(model: PipelineModel) -> int:
    """Entries of a vector that ``forest_predict_proba`` gives."""
    return class_list(model)[-1] + 1


def _scored(model: PipelineModel, rows: DataFrame) -> tuple[DataFrame, Column]:
    features = model.stages[0].getInputCols()
    return model.transform(rows), F.coalesce(is_valid(rows, features), F.lit(False))


def forest_predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The input with ``prediction``; null where a feature is unknown."""
    scored, valid = _scored(model, rows)
    predicted = F.when(valid, F.col("_class").cast("int"))
    return scored.withColumn("prediction", predicted).drop(*FOREST_COLUMNS)


def forest_predict_proba(model: PipelineModel, rows: DataFrame, output: str = "prob") -> DataFrame:
    """The input with one probability per class, indexed by the class label.

    Labels that did not occur have 0. With negative or very large labels use
    ``forest_class_probabilities``.
    """
    classes = class_list(model)
    if classes[0] < 0:
        raise ValueError("negative labels cannot be an index: see forest_class_probabilities")
    scored, valid = _scored(model, rows)
    probabilities = _of_classes(classes)
    if classes != list(range(len(classes))):
        gaps = [high - low - 1 for low, high in zip([-1, *classes], classes)]
        spread = F.zip_with(
            F.lit(gaps),
            probabilities,
            lambda gap, p: F.concat(F.array_repeat(F.lit(0.0), gap), F.array(p)),
        )
        probabilities = F.flatten(spread)
    return scored.withColumn(output, F.when(valid, probabilities)).drop(*FOREST_COLUMNS)


def forest_class_probabilities(
    model: PipelineModel, rows: DataFrame, output: str = "classes"
) -> DataFrame:
    """The input with an array of (class, p), one entry per class that occurs, by class.

    Null where a feature is unknown.
    """
    scored, valid = _scored(model, rows)
    classes = class_list(model)
    listed = F.zip_with(
        F.lit(classes), _of_classes(classes), lambda c, p: F.struct(c.alias("class"), p.alias("p"))
    )
    return scored.withColumn(output, F.when(valid, listed)).drop(*FOREST_COLUMNS)


def _of_classes(classes: Sequence[int]) -> Column:
    """Probabilities by place in the list of classes."""
    probabilities = vector_to_array("_probability")
    return F.slice(probabilities, 1, 1) if len(classes) == 1 else probabilities


def next_state_classifier(
    steps: DataFrame, features: Sequence[str], trees: int = 20, depth: int = 5, seed: int = 0
) -> PipelineModel:
    """A forest predicting NEXT_CLUSTER from the features and ACTION."""
    return forest_fit(steps, [*features, "ACTION"], "NEXT_CLUSTER", trees, depth, seed)


def next_state_distribution(model: PipelineModel, steps: DataFrame) -> DataFrame:
    return forest_predict_proba(model, steps, "prob")


def split_state(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Halve labelled rows of one (state, action) by 2-means on [prob, NEXT_CLUSTER].

    Adds SUB: 0 for the centre that leads to lower next states, else 1.
    """
    vector = Pipeline(
        stages=[
            VectorSizeHint(inputCol="_prob", size=size, handleInvalid="optimistic"),
            VectorAssembler(inputCols=["_prob", "NEXT_CLUSTER"], outputCol="_point"),
        ]
    )
    points = rows.withColumn("_prob", array_to_vector("prob"))
    assembled = vector.fit(points).transform(points)
    model = KMeans(k=2, seed=seed, featuresCol="_point", predictionCol="_half").fit(assembled)
    centres = [[float(x) for x in reversed(c)] for c in model.clusterCenters()]
    first = centres.index(min(centres))
    sub = (F.col("_half") != F.lit(first)).cast("int")
    return model.transform(assembled).withColumn("SUB", sub).drop("_prob", "_point", "_half")


def extend_split(
    halves: DataFrame,
    others: DataFrame,
    features: Sequence[str],
    size: int,
    trees: int = 20,
    depth: int = 7,
    seed: int = 0,
) -> DataFrame:
    """Carry SUB from the halved rows to the state's other rows by a forest.

    Besides the features it uses TIME, RISK and the next-state probabilities.
    """
    entries = {f"_p{i}": F.get("prob", F.lit(i)) for i in range(size)}
    inputs = [*features, "TIME", "RISK", *entries]
    model = forest_fit(halves.withColumns(entries), inputs, "SUB", trees, depth, seed)
    carried = forest_predict(model, others.withColumns(entries))
    extended = carried.withColumn("SUB", F.coalesce("prediction", F.lit(0)))
    return halves.unionByName(extended.drop("prediction", *entries))


def split_sizes() -> list[Column]:
    """Rows of both halves, as aggregates."""
    return [F.count_if(F.col("SUB") == half).alias(f"size_{half}") for half in (0, 1)]


def accept_split(halves: DataFrame, min_splitoff: int = 300) -> DataFrame:
    """Sizes of both halves and whether each is large enough, in one row."""
    return halves.agg(*split_sizes()).withColumn(
        "accepted", (F.col("size_0") >= min_splitoff) & (F.col("size_1") >= min_splitoff)
    )


def surrogate_tree(steps: DataFrame, features: Sequence[str], depth: int = 4) -> PipelineModel:
    """A small decision tree that explains CLUSTER by the features."""
    tree = DecisionTreeClassifier(
        featuresCol="_features",
        labelCol="_label",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        predictionCol="_prediction",
        maxDepth=depth,
    )
    known = skip_invalid(steps, [*features, "CLUSTER"])
    classes = _classes(known, "CLUSTER")
    stages = [_tree_inputs(features), tree, _dictionary(classes)]
    return Pipeline(stages=stages).fit(_coded(known, features, "CLUSTER", classes))


def _tree_inputs(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def stratified_folds(
    rows: DataFrame, features: Sequence[str], label: str, folds: int = 5, seed: int = 0
) -> DataFrame:
    """The different (features, label) with ``fold`` and ``weight``, the rows they stand for.

    Rows of a class are put in the order of a hash and dealt in turn, so any two folds
    differ by at most one row of a class. The n-th class starts with fold n. Equal rows are
    counted first, and an order is kept within slices of a class only, so neither a hot
    class nor a hot row is gathered. Rows with a null or NaN are left out. The result
    depends on the rows and the seed alone, not on their partitions.
    """
    known = skip_invalid(rows, [*features, label])
    return _dealt(_coded(known, features, label, _classes(known, label)), features, folds, seed)


def _dealt(coded: DataFrame, features: Sequence[str], folds: int, seed: int) -> DataFrame:
    counted = coded.groupBy(*features, "_label").agg(F.count(F.lit(1)).alias("_n"))
    hashed = counted.withColumn("_hash", F.xxhash64(F.lit(seed), *features)).withColumn(
        "_slice", F.shiftright("_hash", _SLICE_SHIFT)
    )
    earlier = Window.partitionBy("_label").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_label", "_slice")
        .agg(F.sum("_n").alias("_rows"))
        .select("_label", "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = (
        Window.partitionBy("_label", "_slice")
        .orderBy("_hash", *features)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = hashed.withColumn("_within", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = F.col("_start") + F.col("_within")

    def dealt_before(place: Column, fold: Column) -> Column:
        """Rows of the class before a place that are in the fold."""
        turn = F.pmod(fold - F.col("_label").cast("int"), F.lit(folds))
        return F.floor((place + folds - 1 - turn) / F.lit(folds))

    fold = F.col("fold")
    return (
        placed.join(offsets, ["_label", "_slice"])
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("weight", dealt_before(first + F.col("_n"), fold) - dealt_before(first, fold))
        .where("weight > 0")
        .select(*features, "_label", "fold", F.col("weight").cast("double").alias("weight"))
    )


def grid_search(
    steps: DataFrame,
    features: Sequence[str],
    depths: Sequence[int] = (4,),
    folds: int = 5,
    seed: int = 0,
) -> tuple[PipelineModel, DataFrame]:
    """The surrogate tree of best cross-validated accuracy, and the result table.

    Folds are stratified and the same for every depth. The first of equally good depths
    is the best.
    """
    known = skip_invalid(steps, [*features, "CLUSTER"])
    classes = _classes(known, "CLUSTER")
    dealt = materialize(_dealt(_coded(known, features, "CLUSTER", classes), features, folds, seed))
    attribute = {"name": "_label", "type": "nominal", "num_vals": max(2, len(classes))}
    label = F.col("_label").alias("_label", metadata={"ml_attr": attribute})
    rows = _tree_inputs(features).transform(dealt).select("_features", label, "weight", "fold")
    tree = DecisionTreeClassifier(
        featuresCol="_features",
        labelCol="_label",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        predictionCol="_prediction",
        weightCol="weight",
    )
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).build()
    evaluator = MulticlassClassificationEvaluator(
        labelCol="_label", predictionCol="_prediction", weightCol="weight", metricName="accuracy"
    )
    search = CrossValidator(
        estimator=tree,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        seed=seed,
    ).fit(rows)
    best = search.avgMetrics.index(max(search.avgMetrics))
    table = [
        (depth, float(mean), float(std), place == best)
        for place, (depth, mean, std) in enumerate(zip(depths, search.avgMetrics, search.stdMetrics))
    ]
    schema = "max_depth int, mean_accuracy double, std_accuracy double, best boolean"
    return (
        PipelineModel(stages=[_tree_inputs(features), search.bestModel, _dictionary(classes)]),
        steps.sparkSession.createDataFrame(table, schema),
    )


def tree_rules(model: PipelineModel, steps: DataFrame) -> DataFrame:
    """The rules of a surrogate tree, one row per line, in reading order."""
    features = model.stages[0].getInputCols()
    classes = class_list(model)
    lines = model.stages[1].toDebugString.splitlines()[1:]
    rules = []
    for line in lines:
        text = line.strip()
        if text:
            named = re.sub(r"feature (\d+)", lambda m: features[int(m.group(1))], text)
            named = re.sub(
                r"^Predict: (\d+)\.0$", lambda m: f"Predict: {float(classes[int(m.group(1))])}", named
            )
            rules.append((len(rules), len(line) - len(line.lstrip()), named))
    return steps.sparkSession.createDataFrame(rules, "line int, indent int, rule string")
