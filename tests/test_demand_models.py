"""The registered demand forest queries train the whole model: the function
defaults at product level."""

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from shelfwise.operators import demand as D
from shelfwise.plans import QUERIES


@pytest.mark.parametrize("key", ["train_demand", "predict_demand", "feature_importance"])
def test_demand_forest_is_not_cut(spark, key, monkeypatch):
    asked = []
    fit = D.train_demand

    def recorded(features, level="sku_store", params=D.ForestParams()):
        asked.append((level, params))
        few = features.filter(F.col("product_id") % 40 == 0)
        return fit(few, level, D.ForestParams(num_trees=2, max_depth=3))

    monkeypatch.setattr(D, "train_demand", recorded)
    out = QUERIES[key](spark, SMOKE_DIR)
    assert asked == [("sku_store", D.ForestParams(num_trees=100, max_depth=15))]
    if key == "feature_importance":
        assert sorted(r.feature for r in out.collect()) == sorted(D.FEATURES)
    else:
        assert {"product_id", "store_id", "date"} <= set(out.columns) and out.limit(1).count() == 1
