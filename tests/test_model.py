"""The network against finite differences, and the jobs around it."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import density, encode, losses, sample
from tallyweave.plans import model as modelling
from tallyweave.plans import network, progress, stored

SHAPE = network.Shape(
    features=(("categorical", 3), ("continuous", 1)),
    controls=(("categorical", 2), ("continuous", 1)),
    latent_size=2,
    width=4,
    controls_depth=1,
    encoder_depth=2,
    decoder_depth=1,
)


def some_rows(n=7):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 3, n), rng.random(n)]).astype(float)
    y = np.column_stack([rng.integers(0, 2, n), rng.random(n)]).astype(float)
    return x, y, rng.standard_normal((n, 2))


@pytest.mark.parametrize("controls", [True, False])
def test_gradient_matches_finite_differences(controls):
    shape = SHAPE if controls else network.Shape(SHAPE.features, (), 2, 4, 1, 2, 1)
    x, y, eps = some_rows()
    y = y if controls else np.empty((len(x), 0))
    weights = [np.array([0.5, 1.0, 2.0]), None]
    vector = network.initial(shape, 3)
    _, gradient = network.loss_and_gradient(shape, vector, x, y, eps, 0.2, weights)
    for i in range(shape.length):
        step = np.zeros_like(vector)
        step[i] = 1e-6
        up, _ = network.loss_and_gradient(shape, vector + step, x, y, eps, 0.2, weights)
        down, _ = network.loss_and_gradient(shape, vector - step, x, y, eps, 0.2, weights)
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def people(spark):
    """Two controls, a feature that follows one of them, one that does not, and a number."""
    rows = spark.range(4000).select(
        "id",
        F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("sex"),
        (F.col("id") % 5).cast("int").alias("age"),
        F.when(F.col("id") % 2 == 0, "tea").otherwise("coffee").alias("drink"),
        (F.col("id") % 3).cast("int").alias("job"),
        (F.col("id") % 40).cast("double").alias("hours"),
    )
    return sample.split(rows, ["id"], 1, val=0.2)


@pytest.fixture(scope="module")
def fitted(people):
    ys = encode.fit(people, include=["sex", "age"])
    xs = encode.fit(people, include=["drink", "job", "hours"])
    settings = modelling.Settings(
        latent_size=2, width=8, lr=0.02, batch_size=64, max_epochs=6, min_epochs=6
    )
    untrained = modelling.build(xs, ys, settings, seed=5)
    encoded = modelling.encode_rows(people, xs, ys, ["id", "split"])
    return untrained, encoded, *modelling.fit(encoded, untrained, ["id"], seed=9)


def test_loss_falls(fitted):
    untrained, encoded, trained, history = fitted
    before = modelling.split_losses(encoded, untrained, ["id"], 9, ()).first()["loss"]
    assert min(h["loss"] for h in history) < 0.6 * before
    after = modelling.split_losses(encoded, trained, ["id"], 9).collect()
    assert {r["split"] for r in after} == {"train", "val"}
    assert all(r["loss"] == pytest.approx(r["recon"] + r["kld"]) for r in after)


def test_resumed_fit_is_the_uninterrupted_one(fitted, tmp_path):
    """Also after a driver that ended within an epoch; other seeds and rows are refused."""
    untrained, encoded, _, _ = fitted
    state = f"file://{tmp_path}/state"

    def fit(epochs, state=None, seed=9, rows=encoded):
        settings = replace(untrained.settings, max_epochs=epochs, min_epochs=epochs)
        return modelling.fit(rows, replace(untrained, settings=settings), ["id"], seed, state)

    whole, once = fit(4)
    _, first = fit(2, state)
    assert [h["resumed"] for h in first] == [False, False]
    # Half an epoch, as a driver leaves it that is killed.
    half = tmp_path / "state" / ".epoch=2-1234" / "parameters"
    half.mkdir(parents=True)
    again, second = fit(4, state)
    assert [h["resumed"] for h in second] == [True, True, False, False]
    assert [h["loss"] for h in second] == pytest.approx([h["loss"] for h in once], rel=1e-9)
    assert np.allclose(again.vector, whole.vector, rtol=1e-7, atol=1e-9)
    # Nothing is left to do, and only the last two epochs are kept.
    _, third = fit(4, state)
    assert all(h["resumed"] for h in third) and [h["loss"] for h in third] == [h["loss"] for h in second]
    assert {p.name for p in (tmp_path / "state").iterdir() if p.name[0] == "e"} == {"epoch=2", "epoch=3"}
    with pytest.raises(ValueError, match="own folder"):
        fit(4, state, seed=8)
    with pytest.raises(ValueError, match="own folder"):
        fit(4, state, rows=encoded.where("id <> 7"))


def test_an_epoch_is_stored_once(spark, tmp_path):
    """Two drivers on one folder: the first keeps its epoch."""
    vector = np.arange(3.0)
    one = progress.Progress(spark, f"{tmp_path}/both", "study")
    two = progress.Progress(spark, f"{tmp_path}/both", "study")
    assert one.last() is None
    state = progress.State(0, 5, 0.1, float("nan"), 0, [{"epoch": 0}], vector, vector + 1, vector + 2, vector + 3)
    assert one.commit(state)
    assert not two.commit(replace(state, step=6))
    got = two.last()
    assert (got.epoch, got.step, got.rate, got.history) == (0, 5, 0.1, [{"epoch": 0}]) and np.isnan(got.best_loss)
    assert np.array_equal(got.best, vector + 3) and np.array_equal(got.square, vector + 2)
    assert sorted(p.name for p in (tmp_path / "both").iterdir()) == ["epoch=0"]


def test_losses_equal_the_network(fitted):
    """The aggregation over Spark columns is the loss that training descends."""
    _, encoded, trained, _ = fitted
    rows = modelling.reconstruct(
        encoded.withColumn("eps", F.lit(0)), trained, ["id"], 9, ["id"]
    ).count()
    assert rows == 4000
    data = encoded.orderBy("id").toPandas()
    x = data[["x_drink", "x_job", "x_hours"]].to_numpy(float)
    y = data[["y_sex", "y_age"]].to_numpy(float)
    drawn = sample.with_latents(encoded, ["id"], 2, 9).orderBy("id").select("z").collect()
    eps = np.array([r["z"] for r in drawn])
    weights = [
        None if w is None else np.array(w) for w in modelling.token_weights(trained).values()
    ]
    want, _ = network.loss_and_gradient(
        trained.shape, trained.vector, x, y, eps, trained.settings.beta, weights
    )
    got = modelling.split_losses(encoded, trained, ["id"], 9, ()).first()["loss"]
    assert got == pytest.approx(want, rel=1e-9)


def test_generated_rows_follow_their_controls(fitted, people):
    trained = fitted[2]
    made = modelling.generate(people, trained, ["id"], seed=4).cache()
    assert made.columns == ["id", "sex", "age", "drink", "job", "hours"]
    assert made.dtypes == [(n, t) for n, t in people.drop("split").dtypes]
    assert made.count() == 4000
    same = made.join(people.select("id", "sex", "age"), ["id", "sex", "age"]).count()
    assert same == 4000
    by_sex = {(r["sex"], r["drink"]): r["count"] for r in made.groupBy("sex", "drink").count().collect()}
    assert by_sex.get(("F", "tea"), 0) > 1900 and by_sex.get(("M", "coffee"), 0) > 1900
    drawn = modelling.generate(people, trained, ["id"], seed=4, sample=True)
    names = ["drink", "job"]
    error = density.mean_mean_absolute_error(people.select(names), drawn.select(names))
    assert error < 0.15
    made.unpersist()


def test_rows_do_not_depend_on_partitions(fitted, people):
    trained = fitted[2]
    one = modelling.generate(people.repartition(1), trained, ["id"], 4, sample=True)
    many = modelling.generate(people.repartition(7), trained, ["id"], 4, sample=True)
    assert one.exceptAll(many).count() == 0


def test_tokens_picked_in_the_task_and_in_the_jvm(fitted, people):
    trained = fitted[2]
    rows = encode.encode(people, trained.controls, keep=["id"], prefix="y_")
    probs = modelling.predict(sample.with_latents(rows, ["id"], 2, 4), trained, ["id"])
    slow = encode.decode_probabilities(probs, trained.features, keep=["id"])
    fast = modelling.generate(people, trained, ["id"], 4).select(slow.columns)
    assert slow.exceptAll(fast).count() == 0
    slow = encode.decode_probabilities(
        probs, trained.features, keep=["id"], seed=5, row_key=["id"]
    )
    fast = modelling.generate(people, trained, ["id"], 4, sample=True).select(slow.columns)
    assert slow.exceptAll(fast).count() == 0


def test_stored_model_generates_the_same(spark, fitted, people, tmp_path):
    trained = fitted[2]
    stored.save_model(spark, trained, str(tmp_path / "model"))
    again = stored.load_model(spark, str(tmp_path / "model"))
    assert np.array_equal(again.vector, trained.vector)
    assert again.settings == trained.settings and again.shape == trained.shape
    one = modelling.generate(people, trained, ["id"], 4, sample=True)
    two = modelling.generate(people, again, ["id"], 4, sample=True)
    assert one.exceptAll(two).count() == 0


def test_latents(fitted):
    _, encoded, trained, _ = fitted
    got = modelling.infer(encoded, trained, ["id"], 9, ["id"])
    row = got.orderBy("id").first()
    assert len(row["mu"]) == len(row["log_var"]) == len(row["z"]) == 2
    eps = sample.with_latents(encoded, ["id"], 2, 9).orderBy("id").first()["z"]
    for m, lv, z, e in zip(row["mu"], row["log_var"], row["z"], eps):
        assert z == pytest.approx(m + np.exp(lv / 2) * e)


def test_unconditional(people):
    xs = encode.fit(people, include=["drink", "job"])
    settings = modelling.Settings(2, 8, max_epochs=1, min_epochs=1, weighted=False)
    untrained = modelling.build(xs, None, settings, seed=5)
    encoded = modelling.encode_rows(people, xs, None, ["id", "split"])
    trained, history = modelling.fit(encoded, untrained, ["id"], seed=9)
    assert len(history) == 1
    made = modelling.generate(people, trained, ["id"], seed=4, keep_latents=True)
    assert made.columns == ["id", "drink", "job", "z"]
    assert made.count() == 4000


def test_guards(people):
    xs = encode.fit(people, include=["drink"])
    with pytest.raises(ValueError, match="beta"):
        modelling.build(xs, None, modelling.Settings(beta=1.0), 1)
    timed = encode.fit(people, include=["hours"], overrides={"hours": "time"})
    with pytest.raises(ValueError, match="time"):
        modelling.build(timed, None, modelling.Settings(), 1)
    with pytest.raises(ValueError, match="beta"):
        losses.require_beta(1)


def test_hand_computed_losses(spark):
    rows = spark.createDataFrame([(0.7, 1.0), (0.2, 3.0)], "p double, w double")
    nll = losses.weighted_mean(-F.log("p"), F.col("w"))
    assert rows.agg(nll.alias("x")).first()["x"] == pytest.approx(1.2962471703)
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "mu array<double>, lv array<double>")
    assert one.agg(losses.mean_kl(F.col("mu"), F.col("lv")).alias("x")).first()["x"] == 0.5
