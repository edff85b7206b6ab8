"""How the learners run their fits: at once where they can, on no more partitions than pay."""

import threading

from pyspark.ml.regression import LinearRegression

from tauframe.operators import learners as le
from tauframe.spec import CausalSpec

SPEC = CausalSpec("id", "t", "y", ("a",))


def units(spark):
    rows = [(i, i % 2, float(i % 7) + (i % 2), float(i % 5)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, t int, y double, a double")


def test_small_tables_are_read_in_few_partitions(spark):
    seen = []

    class Probe(LinearRegression):
        def fit(self, dataset, params=None):
            seen.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset, params)

    most = spark.sparkContext.defaultParallelism
    df = units(spark).repartition(3 * most + 1)
    for fit in (le.fit_s_learner, le.fit_t_learner, le.fit_x_learner, le.fit_dr_learner):
        model = fit(df, SPEC, Probe(solver="normal"))
        assert model.predict(df, "tau").where("tau IS NOT NULL").count() == 300
    assert len(seen) == 1 + 1 + 2 + 6 and max(seen) <= most


def test_outcome_models_are_fitted_at_once(spark):
    both = threading.Barrier(2)

    class Waits(LinearRegression):
        def fit(self, dataset, params=None):
            both.wait(timeout=60)
            return super().fit(dataset, params)

    le.fit_x_learner(units(spark), SPEC, Waits(solver="normal"))
