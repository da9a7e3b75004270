"""Multi-label classification of questions, and rules that label them from their words."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# Labels, and the probability from which each holds.
LABELS = ("fund_basic", "fund_portfolio", "fund_profile", "company_people", "company_filing", "not_related")
THRESHOLDS = {"fund_portfolio": 0.3}
OTHERWISE = 0.5

# Words that speak for each label.
WORDS = {
    "fund_basic": r"expense ratio|net assets|turnover|ticker|share class|nav\b|total return|average return|provider|trust",
    "fund_portfolio": r"holding|portfolio|sector|allocation|weight|region|invests? in|exposure",
    "fund_profile": r"strateg|objective|risk|manager|prospectus|performance commentary",
    "company_people": r"\bceo\b|compensation|insider|executive|chief",
    "company_filing": r"10-?k|revenue|net income|segment|legal proceeding|properties|business information|risk factor",
}


def rule_labels(text: str) -> Column:
    """Labels whose words a question has; not_related where none has."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.filter(F.array(*[F.when(low.rlike(p), name) for name, p in WORDS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("not_related")))


def decide(probabilities: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Labels above their threshold, the most probable first; the most probable alone where none is."""
    pairs = F.transform(F.arrays_zip(probabilities.alias("p"), F.array(*map(F.lit, labels)).alias("l")), lambda z: F.struct((-z["p"]).alias("p"), z["l"].alias("l")))
    least = F.create_map(*[F.lit(x) for name in labels for x in (name, THRESHOLDS.get(name, OTHERWISE))])
    ranked = F.array_sort(pairs)
    above = F.transform(F.filter(ranked, lambda z: -z["p"] >= least[z["l"]]), lambda z: z["l"])
    return F.when(F.size(above) > 0, above).otherwise(F.array(F.get(ranked, F.lit(0))["l"]))


class Classifier:
    """One logistic regression a label over hashed words."""

    def __init__(self, labels: tuple[str, ...], features: PipelineModel, models: dict):
        self.labels, self.features, self.models = labels, features, models

    @classmethod
    def train(cls, rows: DataFrame, labels: tuple[str, ...] = LABELS, text: str = "text", truth: str = "labels", size: int = 1 << 14) -> Classifier:
        features = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[^a-z0-9]+"), HashingTF(inputCol="__w", outputCol="__f", numFeatures=size)]).fit(rows)
        ready, models = features.transform(rows).select("__f", truth).cache(), {}
        for name in labels:
            marked = ready.select("__f", F.array_contains(truth, name).cast("double").alias("__y"))
            models[name] = LogisticRegression(featuresCol="__f", labelCol="__y", regParam=0.01, maxIter=30).fit(marked)
        ready.unpersist()
        return cls(labels, features, models)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with probabilities and guessed labels."""
        df = self.features.transform(rows)
        for i, name in enumerate(self.labels):
            m = self.models[name].setPredictionCol(f"__p{i}").setProbabilityCol(f"__q{i}").setRawPredictionCol(f"__r{i}")
            df = m.transform(df)
        p = F.array(*[F.get(vector_to_array(f"__q{i}"), F.lit(1)) for i in range(len(self.labels))])
        return df.withColumn("probabilities", p).withColumn("guess", decide(F.col("probabilities"), self.labels)).select(*rows.columns, "probabilities", "guess")
