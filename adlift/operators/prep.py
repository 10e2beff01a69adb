"""Leakage-free feature preparation as a Spark ML Estimator / Model pair.

fit (train rows only):  median of each numeric column (exact or approximate),
                        then mean and population std of the median-imputed
                        values — two aggregate passes, nine numbers collected.
transform:              coalesce(x, median) -> (x - mean) / (std or 1);
                        null category -> 'missing'; one-hot on the fixed
                        category list, unknown and 'missing' -> all zeros.
Everything in transform is a column expression with literal parameters, so
scoring stays in whole-stage codegen and needs no join.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.constants import CATEGORICAL, CATEGORIES, MISSING_CATEGORY, NUMERIC
from adlift.operators.quantiles import grouped_with_quantiles


def scaled_name(c: str) -> str:
    return f"{c}_scaled"


def onehot_name(cat_col: str, v: str) -> str:
    return f"{cat_col}_{v.lower()}"


def output_columns(numeric=NUMERIC, cat_col=CATEGORICAL, categories=CATEGORIES) -> list[str]:
    return [scaled_name(c) for c in numeric] + [onehot_name(cat_col, v) for v in categories]


def feature_labels(numeric=NUMERIC, cat_col=CATEGORICAL, categories=CATEGORIES) -> list[str]:
    """Readable names of the transformed features, in vector order."""
    return list(numeric) + [f"{cat_col}_{v}" for v in categories]


class _PrepParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCol = Param(Params._dummy(), "categoricalCol", "categorical column", TypeConverters.toString)
    categories = Param(Params._dummy(), "categories", "ordered categories", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "assembled vector column ('' for none)",
                      TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=NUMERIC, categoricalCol=CATEGORICAL, categories=CATEGORIES,
                         outputCol="")


class CampaignPreprocessor(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation + standardisation + one-hot, fitted on the rows given."""

    quantileMethod = Param(Params._dummy(), "quantileMethod", "exact | approx", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCol=None, categories=None, outputCol=None,
                 quantileMethod="session"):
        super().__init__()
        self._setDefault(quantileMethod="session")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CampaignPreprocessorModel":
        cols = self.getOrDefault("numericCols")
        method = self.getOrDefault("quantileMethod")
        long = df.select(*cols).unpivot([], cols, "feature", "value")
        med = {r["feature"]: r["median"] for r in
               grouped_with_quantiles(long, ["feature"], "value", {"median": 0.5}, [], method).collect()}
        medians = [float(med[c]) if med.get(c) is not None else 0.0 for c in cols]
        imp = [F.coalesce(F.col(c), F.lit(m)) for c, m in zip(cols, medians)]
        mom = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(imp)],
                     *[F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(imp)]).first()
        means = [float(mom[f"m{i}"] or 0.0) for i in range(len(cols))]
        scales = [float(mom[f"s{i}"]) if mom[f"s{i}"] else 1.0 for i in range(len(cols))]
        m = CampaignPreprocessorModel(medians=medians, means=means, scales=scales)
        for p in ("numericCols", "categoricalCol", "categories", "outputCol"):
            m._set(**{p: self.getOrDefault(p)})
        return m


class CampaignPreprocessorModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "train medians", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "train means after imputation", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "train population std (1 when constant)",
                   TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, medians=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def feature_exprs(self) -> dict:
        cols = self.getOrDefault("numericCols")
        cat = self.getOrDefault("categoricalCol")
        out = {}
        for c, md, mu, sd in zip(cols, self.getOrDefault("medians"), self.getOrDefault("means"),
                                 self.getOrDefault("scales")):
            out[scaled_name(c)] = (F.coalesce(F.col(c), F.lit(md)) - F.lit(mu)) / F.lit(sd)
        filled = F.coalesce(F.col(cat), F.lit(MISSING_CATEGORY))
        for v in self.getOrDefault("categories"):
            out[onehot_name(cat, v)] = F.when(filled == v, F.lit(1.0)).otherwise(F.lit(0.0))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        res = df.withColumns(self.feature_exprs())
        out = self.getOrDefault("outputCol")
        if out:
            res = VectorAssembler(inputCols=list(self.feature_exprs()), outputCol=out).transform(res)
        return res
