"""What the review of round 1 found."""

import numpy as np

import __spark_entry__ as entry
from loamwork.operators import encoder
from loamwork.plans.q_bins import rows
from tests import density_twin


def test_density_parts_take_whole_vectors(spark, sf):
    want = {}
    r = rows(spark, sf).where("label >= 0").toPandas()
    for _, g in r.groupby("label"):
        g = g.sort_values("contig_id")
        want |= dict(zip(g["contig_id"], density_twin.labels(np.stack(g["vec"].to_list()), 4, 2, "leaf")[0], strict=True))
    got = {x.contig_id: x.part for x in entry.queries()["density_parts"](spark, sf).collect()}
    assert got.keys() == want.keys() and {i for i in got if got[i] < 0} == {i for i in want if want[i] < 0}
    label = dict(zip(r["contig_id"], r["label"], strict=True))
    assert len({(label[i], got[i]) for i in got}) == len({(label[i], want[i]) for i in got}) == len({(label[i], got[i], want[i]) for i in got})


def test_training_takes_all_rows(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(20_600, 3))
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "contig_id long, vec array<double>").cache()
    model = encoder.Vae(latent=2, epochs=2)
    out = encoder.encode(made, model)
    assert model.t == model.steps(len(x)) == 2 * 81
    assert out.count() == len(x) and model.loss(x) < encoder.Vae(latent=2).start(x.mean(0)).loss(x)
    few = encoder.Vae(latent=2, epochs=2)
    encoder.encode(made, few, train_rows=512)
    assert few.t == 4
