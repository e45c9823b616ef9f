"""Random forests walk rows on from their last node: same trees, less work a level."""

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler

from vigil.ml.models import make_estimator


def test_forest_caches_node_ids_and_grows_the_same_trees(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=["a", "b", "c"])
    pdf["label"] = (pdf["a"] * pdf["b"] > 0).astype(float)
    d = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf)).cache()
    for task in ("classification", "regression"):
        est = make_estimator("random_forest", task, d, {"n_estimators": 3})
        assert est.getCacheNodeIds()
        assert est.fit(d).toDebugString.split("\n")[1:] == est.copy().setCacheNodeIds(False).fit(d).toDebugString.split("\n")[1:]
