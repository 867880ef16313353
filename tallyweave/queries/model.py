"""Losses, the fitted conditional model, synthesis and trials."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.functions import arrays, draws
from tallyweave.functions.recode import AGE_BANDS, SEX_CODES, recode
from tallyweave.operators import controls, density, encode, lookups, losses, sample
from tallyweave.plans import model as modelling
from tallyweave.plans import synthesis, trials
from tallyweave.queries.encoding import _FLAG_SQL, flag_probabilities
from tallyweave.queries.recode import _TOTALS_SQL, projection, recoded_projection, zone_regions
from tallyweave.queries.registry import query, round_doubles, rounded, table
from tallyweave.session import cut_lineage, scratch, spread


def _scored_lines(spark, folder):
    """Each line's return flag token and weight, and the flag shares of its line status."""
    plan, given = flag_probabilities(spark, folder)
    lines = table(spark, folder, "lineitem").select("l_linestatus", "l_returnflag")
    tokens = encode.encode(lines, plan, keep=["l_linestatus"])
    return plan, lookups.look_up(tokens, given, "l_linestatus")


_NLL_SQL = f"""WITH {_FLAG_SQL}, counts AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL),
    weights AS (SELECT l_returnflag, avg(n) OVER () / n AS w FROM counts),
    lines AS (SELECT l.l_linestatus, -ln(p) AS nll, w FROM lineitem l
        JOIN probs p ON l.l_linestatus = p.l_linestatus AND l.l_returnflag = p.l_returnflag
        JOIN weights w ON l.l_returnflag = w.l_returnflag)"""


@query(
    f"""{_NLL_SQL} SELECT l_linestatus, round(sum(w * nll) / sum(w), 9) AS nll FROM lines
    GROUP BY l_linestatus"""
)
def weighted_nll(spark, folder):
    plan, rows = _scored_lines(spark, folder)
    weights = F.array(*map(F.lit, plan.weights()["l_returnflag"]))
    token = F.col("l_returnflag")
    cost = losses.weighted_mean(
        losses.token_loss(token, F.col("p_l_returnflag")), F.get(weights, token)
    )
    return rows.groupBy("l_linestatus").agg(rounded(cost).alias("nll"))


_KL_SQL = """(SELECT vec_id, label, -0.5 * sum(1 + lv - mu * mu - exp(lv)) AS kl FROM (
    SELECT vec_id, label, CAST(embedding[d] AS DOUBLE) AS mu, CAST(embedding[d + 32] AS DOUBLE) AS lv
    FROM embeddings, range(1, 33) r(d)) GROUP BY vec_id, label)"""


def _latents(spark, folder):
    """The first half of each embedding as means, the second as log variances."""
    vectors = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        F.slice(vectors, 1, 32).alias("mu"),
        F.slice(vectors, 33, 32).alias("log_var"),
    )


@query(f"SELECT label, round(avg(kl), 9) AS kld FROM {_KL_SQL} GROUP BY label")
def kl_divergence(spark, folder):
    return _latents(spark, folder).groupBy("label").agg(
        rounded(losses.mean_kl(F.col("mu"), F.col("log_var"))).alias("kld")
    )


@query(
    """SELECT vec_id, CAST(d - 1 AS INTEGER) AS dim, round(mu + exp(lv / 2) * sqrt(-2 * ln(1 -
            ('0x' || substr(h, 1, 8))::UBIGINT / 4294967296.0::DOUBLE))
        * cos(2 * pi() * ('0x' || substr(h, 9, 8))::UBIGINT / 4294967296.0::DOUBLE), 9) AS z
    FROM (SELECT vec_id, d, CAST(embedding[d] AS DOUBLE) AS mu, CAST(embedding[d + 32] AS DOUBLE) AS lv,
        md5('3:' || vec_id || ':' || (d - 1)) AS h FROM embeddings, range(1, 33) r(d))"""
)
def reparameterised(spark, folder):
    eps = draws.normals(32, 3, F.col("vec_id"))
    z = arrays.reparameterise(F.col("mu"), F.col("log_var"), eps)
    return _latents(spark, folder).select(
        "vec_id", F.posexplode(z).alias("dim", "z")
    ).withColumn("z", rounded("z"))


@query(
    f"""{_NLL_SQL}, parts AS (SELECT (SELECT sum(w * nll) / sum(w) FROM lines) AS nll,
        (SELECT avg(kl) FROM {_KL_SQL}) AS kl)
    SELECT round(0.9::DOUBLE * nll + 0.1::DOUBLE * kl, 9) AS loss, round(0.9::DOUBLE * nll, 9) AS recon,
        round(0.1::DOUBLE * kl, 9) AS kld FROM parts"""
)
def elbo(spark, folder):
    """Reconstruction of the return flags and divergence of the embeddings as one loss."""
    plan, rows = _scored_lines(spark, folder)
    weights = F.array(*map(F.lit, plan.weights()["l_returnflag"]))
    token = F.col("l_returnflag")
    recon = losses.weighted_mean(
        losses.token_loss(token, F.col("p_l_returnflag")), F.get(weights, token)
    )
    nll = rows.agg(recon.alias("nll")).scalar()
    kl = losses.mean_kl(F.col("mu"), F.col("log_var"))
    parts = _latents(spark, folder).agg(kl.alias("kl")).withColumn("nll", nll)
    loss, recon_part, kld_part = losses.total_loss(F.col("nll"), F.col("kl"), 0.1)
    return parts.select(
        rounded(loss).alias("loss"), rounded(recon_part).alias("recon"), rounded(kld_part).alias("kld")
    )


_SYNTH_SQL = """real AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders),
    words AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER)
        AS token FROM (SELECT DISTINCT o_orderpriority FROM real)),
    groups AS (SELECT DISTINCT o_orderstatus FROM real),
    probs AS (SELECT g.o_orderstatus, w.token, coalesce(c.n, 0)
            / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.o_orderstatus)::DOUBLE AS p
        FROM groups g CROSS JOIN words w LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n
            FROM real GROUP BY ALL) c
        ON c.o_orderstatus = g.o_orderstatus AND c.o_orderpriority = w.o_orderpriority),
    running AS (SELECT *, sum(p) OVER (PARTITION BY o_orderstatus ORDER BY token
            ROWS UNBOUNDED PRECEDING) AS upto, sum(p) OVER (PARTITION BY o_orderstatus ORDER BY token
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total,
            count(*) OVER (PARTITION BY o_orderstatus) AS k FROM probs),
    drawn AS (SELECT o_orderkey, o_orderstatus, ('0x' || substr(md5('11:o_orderpriority:' || o_orderkey), 1, 8))
            ::UBIGINT / 4294967296.0::DOUBLE AS u FROM real),
    tokens AS (SELECT o_orderkey, o_orderstatus, least(count(*) FILTER (upto <= u * total), any_value(k) - 1) AS token
        FROM drawn JOIN running USING (o_orderstatus) GROUP BY o_orderkey, o_orderstatus),
    synthetic AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM tokens JOIN words USING (token))"""


def _drawn_orders(spark, folder):
    """Real orders, and the same orders with a priority drawn given their status."""
    real = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    plan = encode.fit(real, include=["o_orderpriority"])
    tokens = encode.encode(real, plan, keep=["o_orderstatus"], prefix="x_")
    size = plan["o_orderpriority"].size
    rows = F.count(F.lit(1))
    shares = [F.count_if(F.col("x_o_orderpriority") == k) / rows for k in range(size)]
    given = tokens.groupBy("o_orderstatus").agg(F.array(*shares).alias("p_o_orderpriority"))
    given_rows = real.select("o_orderkey", "o_orderstatus")
    paired = lookups.look_up(given_rows, cut_lineage(given), "o_orderstatus")
    synthetic = encode.decode_probabilities(
        paired, plan, keep=["o_orderkey", "o_orderstatus"], seed=11, row_key=["o_orderkey"]
    )
    return real, synthetic


@query(f"WITH {_SYNTH_SQL} SELECT * FROM synthetic")
def synthetic_rows(spark, folder):
    return _drawn_orders(spark, folder)[1]


def _mae_sql(keys):
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    names = ", ".join(keys)
    return f"""SELECT '{"_".join(keys)}' AS combo, round(avg(abs(coalesce(t.n, 0) / total::DOUBLE
            - coalesce(s.n, 0) / total::DOUBLE)), 9) AS mae
        FROM (SELECT {names}, count(*) AS n FROM real GROUP BY ALL) t
        FULL JOIN (SELECT {names}, count(*) AS n FROM synthetic GROUP BY ALL) s ON {on},
        (SELECT count(*) AS total FROM real)"""


@query(
    f"""WITH {_SYNTH_SQL} {_mae_sql(["o_orderstatus"])} UNION ALL {_mae_sql(["o_orderpriority"])}
    UNION ALL {_mae_sql(["o_orderstatus", "o_orderpriority"])}"""
)
def conditional_synthesis(spark, folder):
    """Draw a feature for every control row from its conditional shares, and judge the result."""
    real, synthetic = _drawn_orders(spark, folder)
    errors = density.evaluate(real, synthetic, [1, 2], exclude=["o_orderkey"])
    return round_doubles(errors.select("combo", "mae"))


SETTINGS = modelling.Settings(
    latent_size=4, width=16, lr=0.01, batch_size=256, min_epochs=2, max_epochs=2
)


def prepared_orders(spark, folder):
    """Orders with two controls and three features, one of them a number."""
    orders = spread(table(spark, folder, "orders")).select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        F.month("o_orderdate").alias("month"),
        F.dayofweek("o_orderdate").alias("weekday"),
        "o_totalprice",
    )
    given = ["o_orderstatus", "o_orderpriority"]
    return synthesis.prepare(orders, given, ["o_orderkey"], seed=1234, val=0.1, test=0.1)


_SPLIT_SQL = """SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, ('0x' || substr(md5('1234:' || o_orderkey), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM orders)"""


@query(f"SELECT split, count(*) AS n, true AS finite, true AS better FROM ({_SPLIT_SQL}) GROUP BY split")
def fit_cvae_losses(spark, folder):
    """By split, whether all losses of a model of two epochs are numbers and the loss is below the untrained one."""
    prepared = prepared_orders(spark, folder)
    untrained = modelling.build(prepared.features, prepared.controls, SETTINGS, 1234)
    model, _ = modelling.fit(prepared.encoded, untrained, prepared.key, 1234)
    before = modelling.split_losses(prepared.encoded, untrained, prepared.key, 1234)
    after = modelling.split_losses(prepared.encoded, model, prepared.key, 1234)
    numbers = [F.col(c) for c in after.columns if c not in ("split", "n")]
    finite = F.lit(True)
    for number in numbers:
        finite = finite & F.coalesce(F.abs(number) < float("inf"), F.lit(False))
    return after.select("split", "n", finite.alias("finite"), "loss").join(
        before.select("split", F.col("loss").alias("untrained")), "split"
    ).select("split", "n", "finite", (F.col("loss") < F.col("untrained")).alias("better"))


@query(
    """SELECT o_orderkey, CAST(dim AS INTEGER) AS dim, round(sqrt(-2 * ln(1 -
            ('0x' || substr(h, 1, 8))::UBIGINT / 4294967296.0::DOUBLE))
        * cos(2 * pi() * ('0x' || substr(h, 9, 8))::UBIGINT / 4294967296.0::DOUBLE), 6) AS noise
    FROM (SELECT o_orderkey, dim, md5('1234:' || o_orderkey || ':' || dim) AS h
        FROM orders, range(4) r(dim))"""
)
def infer_latents(spark, folder):
    """The noise in the latents inferred for every order: what is left of a draw less its mean, over its spread."""
    prepared = prepared_orders(spark, folder)
    model, _ = synthesis.train(prepared, SETTINGS, seed=1234)
    latents = modelling.infer(prepared.encoded, model, ["o_orderkey"], 1234, ["o_orderkey"])
    parts = F.posexplode(F.arrays_zip("mu", "log_var", "z")).alias("dim", "at")
    noise = (F.col("at.z") - F.col("at.mu")) / F.exp(F.col("at.log_var") / 2)
    return latents.select("o_orderkey", parts).select(
        "o_orderkey", "dim", (F.round(noise, 6) + 0.0).alias("noise")
    )


@query(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_orderkey) AS orders, count(*) AS valid
    FROM orders GROUP BY ALL"""
)
def fitted_synthesis(spark, folder):
    """A synthetic order for every order: by control, how many, and how many have known values."""
    prepared = prepared_orders(spark, folder)
    model, _ = synthesis.train(prepared, SETTINGS, seed=1234)
    made = modelling.generate(prepared.data, model, prepared.key, 1234, sample=True)
    price = prepared.features["o_totalprice"]
    valid = (
        F.col("month").between(1, 12)
        & F.col("weekday").between(1, 7)
        & F.col("o_totalprice").between(price.low, price.low + price.span)
    )
    return made.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.count_if(valid).alias("valid")
    )


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS orders, count(*) AS valid FROM orders")
def unconditional_synthesis(spark, folder):
    """The variant without controls and category weights: how many rows, and how many have known values."""
    orders = spread(table(spark, folder, "orders")).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("month")
    )
    prepared = synthesis.prepare(orders, [], ["o_orderkey"], seed=1234)
    settings = modelling.Settings(
        latent_size=4, width=16, lr=0.01, max_epochs=1, min_epochs=1, weighted=False
    )
    model, _ = synthesis.train(prepared, settings, seed=1234)
    made = modelling.generate(orders, model, prepared.key, 1234, sample=True)
    known = orders.select("o_orderstatus", "o_orderpriority").distinct().withColumn("known", F.lit(True))
    made = made.join(known, ["o_orderstatus", "o_orderpriority"], "left")
    # Every status and priority occur together.
    valid = F.col("known") & F.col("month").between(1, 12)
    return made.agg(
        F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"), F.count_if(valid).alias("valid")
    )


def _draw_sql(path):
    return f"('0x' || substr(md5('7:' || trial || ':{path}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"


@query(
    f"""SELECT trial, CASE WHEN {_draw_sql("width")} < 0.5 THEN 8 ELSE 16 END AS width,
        CASE WHEN {_draw_sql("latent_size")} < 0.5 THEN 2 ELSE 4 END AS latent_size,
        round(exp(ln(0.001) + {_draw_sql("lr")} * (ln(0.05) - ln(0.001))), 9) AS lr, true AS scored, true AS in_order
    FROM range(2) t(trial), (SELECT count(*) FROM orders)"""
)
def trial_ranking(spark, folder):
    """The settings of two trials over the model, whether each has an objective, and whether the best come first."""
    tree = {
        "width": trials.Choice([8, 16]),
        "latent_size": trials.IntRange(2, 4, step=2),
        "lr": trials.FloatRange(0.001, 0.05, log=True),
        "max_epochs": 1,
        "min_epochs": 1,
    }
    prepared = prepared_orders(spark, folder)
    scored = synthesis.tune(prepared, tree, scratch(spark, "trials"), trials=2, seed=7, workers=2)
    # As many rows as trials.
    ranked = trials.best_trials(scored, 2).withColumn("place", F.monotonically_increasing_id())
    before = F.lag("objective").over(Window.orderBy("place"))
    settings = F.col("settings")
    return ranked.select(
        "trial",
        settings["width"].cast("int").alias("width"),
        settings["latent_size"].cast("int").alias("latent_size"),
        rounded(settings["lr"].cast("double")).alias("lr"),
        F.col("objective").between(0, 1).alias("scored"),
        F.coalesce(F.col("objective") >= before, F.lit(True)).alias("in_order"),
    )


@query(
    f"""{_TOTALS_SQL} SELECT zone, region, sex, age_group, value AS n, value AS valid FROM totals WHERE value > 0"""
)
def projected_people(spark, folder):
    """From control totals to people: every counted person of a projection gets a feature from a model.

    The model is fitted on the customers, by region, sex and age group. People are counted by control again, and
    so are those with a known segment.
    """
    customers = projection(spark, folder, keep=("c_custkey", "c_mktsegment"))
    zones = zone_regions(spark, folder).select(F.concat(F.lit("Z"), F.col("zone")).alias("geogcode"), "region")
    customers = lookups.look_up(customers, zones, "geogcode").select(
        "c_custkey",
        "c_mktsegment",
        "region",
        recode(F.col("Gender"), SEX_CODES).alias("sex"),
        recode(F.col("Age"), AGE_BANDS).alias("age_group"),
    )
    prepared = synthesis.prepare(customers, ["region", "sex", "age_group"], ["c_custkey"], seed=1234)
    settings = replace(SETTINGS, max_epochs=1, min_epochs=1)
    model, _ = synthesis.train(prepared, settings, seed=1234)
    totals = controls.control_totals(recoded_projection(spark, folder))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("zone", "sex", "age_group", "person")]
    people = controls.expand_controls(totals).withColumn("pid", F.concat_ws("|", *parts))
    made = modelling.generate(people, model, ["pid"], 1234, sample=True)
    segments = prepared.features.words("c_mktsegment").select(F.col("value").alias("c_mktsegment"), F.lit(True).alias("known"))
    made = lookups.look_up(made, segments, "c_mktsegment")
    return (
        made.groupBy(F.substring_index("pid", "|", 1).alias("zone"), "region", "sex", "age_group")
        .agg(F.count("*").alias("n"), F.count_if("known").alias("valid"))
    )


# A network of width 1 with weights set by hand, in place of trained ones. Token k has the k-th value.
HAND_SET = {
    "y0": [-0.1, 0.1, 0.3],
    "label0": (0.8, 0.05),
    "x0": [0.4, 0.2, 0.0, -0.2, -0.4],
    "enc0": (1.5, 0.25),
    "mu": (0.9, -0.3),
    "var": (-0.5, 0.1),
    "dec0": (0.7, 0.2),
    "out0": ([-0.5, -0.2, 0.1, 0.4, 0.7], [0.0, 0.1, 0.2, 0.3, 0.4]),
}
_HAND_SQL = f"""rows AS (SELECT o_orderkey, o_totalprice / 100000.0 AS z,
        dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS s, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS t
        FROM orders),
    labels AS (SELECT *, {HAND_SET["y0"]}[s + 1]::DOUBLE * {HAND_SET["label0"][0]}::DOUBLE
        + {HAND_SET["label0"][1]}::DOUBLE AS label FROM rows)"""


def hand_set_model(spark, folder, orders=None, weights=None, keep=("o_orderkey", "o_totalprice")):
    """Orders encoded with the status as control and the priority as feature, and the network."""
    if orders is None:
        orders = spread(table(spark, folder, "orders")).select(
            "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
        )
    plan = encode.fit(orders, include=["o_orderstatus", "o_orderpriority"])
    features, given = plan.only(["o_orderpriority"]), plan.only(["o_orderstatus"])
    model = modelling.build(features, given, modelling.Settings(1, 1, 0, 0, 0), 0)
    views = model.shape.views(model.vector)
    for name, value in (weights or HAND_SET).items():
        if isinstance(value, list):
            views[name][:, 0] = value
        else:
            views[f"{name}.w"][...], views[f"{name}.b"][...] = value
    return modelling.encode_rows(orders, features, given, list(keep)), model


@query(
    f"""WITH {_HAND_SQL}, hidden AS (SELECT o_orderkey, z * {HAND_SET["dec0"][0]}::DOUBLE
            + {HAND_SET["dec0"][1]}::DOUBLE + label AS h FROM labels),
    scores AS (SELECT o_orderkey, k AS token, exp(h * {HAND_SET["out0"][0]}[k + 1]::DOUBLE
            + {HAND_SET["out0"][1]}[k + 1]::DOUBLE) AS e FROM hidden, range(5) r(k))
    SELECT o_orderkey, CAST(token AS INTEGER) AS token,
        round(e / sum(e) OVER (PARTITION BY o_orderkey), 9) AS p FROM scores"""
)
def predict_fixed(spark, folder):
    """Probabilities of every priority by a network of known weights, from a latent that is the price."""
    rows, model = hand_set_model(spark, folder)
    rows = rows.withColumn("z", F.array(F.col("o_totalprice") / 100000.0))
    made = modelling.predict(rows, model, ["o_orderkey"])
    return made.select("o_orderkey", F.posexplode("p_o_orderpriority").alias("token", "p")).withColumn(
        "p", rounded("p")
    )


@query(
    f"""WITH {_HAND_SQL}, hidden AS (SELECT o_orderkey, ({HAND_SET["x0"]}[t + 1]::DOUBLE + label)
            * {HAND_SET["enc0"][0]}::DOUBLE + {HAND_SET["enc0"][1]}::DOUBLE AS h FROM labels)
    SELECT o_orderkey, round(h * {HAND_SET["mu"][0]}::DOUBLE + {HAND_SET["mu"][1]}::DOUBLE, 9) AS mu,
        round(h * {HAND_SET["var"][0]}::DOUBLE + {HAND_SET["var"][1]}::DOUBLE, 9) AS log_var FROM hidden"""
)
def infer_fixed(spark, folder):
    """Mean and log variance of every order's latent by a network of known weights."""
    rows, model = hand_set_model(spark, folder)
    made = modelling.infer(rows, model, ["o_orderkey"], 5, ["o_orderkey"])
    return made.select(
        "o_orderkey", rounded(F.get("mu", F.lit(0))).alias("mu"), rounded(F.get("log_var", F.lit(0))).alias("log_var")
    )


def _unit_sql(digest, start=1):
    return f"('0x' || substr({digest}, {start}, 8))::UBIGINT / 4294967296.0::DOUBLE"


def _noise_sql(seed, key="o_orderkey", dim="0"):
    digest = f"md5('{seed}:' || {key} || ':' || {dim})"
    return f"sqrt(-2 * ln(1 - {_unit_sql(digest)})) * cos(2 * pi() * {_unit_sql(digest, 9)})"


# The hidden value of a latent, and the probabilities of its tokens.
_DECODED_SQL = f"""hidden AS (SELECT *, z * {HAND_SET["dec0"][0]}::DOUBLE + {HAND_SET["dec0"][1]}::DOUBLE + label AS h FROM drawn),
    scores AS (SELECT o_orderkey, k AS token, exp(h * {HAND_SET["out0"][0]}[k + 1]::DOUBLE
            + {HAND_SET["out0"][1]}[k + 1]::DOUBLE) AS e FROM hidden, range(5) r(k)),
    probs AS (SELECT o_orderkey, token, e / sum(e) OVER (PARTITION BY o_orderkey) AS p FROM scores)"""
_ENCODED_SQL = f"""latents AS (SELECT *, h * {HAND_SET["mu"][0]}::DOUBLE + {HAND_SET["mu"][1]}::DOUBLE AS mu,
        h * {HAND_SET["var"][0]}::DOUBLE + {HAND_SET["var"][1]}::DOUBLE AS log_var
    FROM (SELECT *, ({HAND_SET["x0"]}[t + 1]::DOUBLE + label) * {HAND_SET["enc0"][0]}::DOUBLE + {HAND_SET["enc0"][1]}::DOUBLE AS h
        FROM labels))"""


@query(
    f"""WITH {_HAND_SQL}, drawn AS (SELECT o_orderkey, label, {_noise_sql(1234)} AS z FROM labels), {_DECODED_SQL},
    running AS (SELECT *, sum(p) OVER (PARTITION BY o_orderkey ORDER BY token ROWS UNBOUNDED PRECEDING) AS upto,
        sum(p) OVER (PARTITION BY o_orderkey ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total,
        {_unit_sql("md5('1235:o_orderpriority:' || o_orderkey)")} AS u FROM probs),
    tokens AS (SELECT o_orderkey, least(count(*) FILTER (upto <= u * total), 4) AS token FROM running GROUP BY o_orderkey),
    words AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS token
        FROM (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT o_orderkey, o.o_orderstatus, w.o_orderpriority FROM orders o JOIN tokens USING (o_orderkey) JOIN words w USING (token)"""
)
def generate_fixed(spark, folder):
    """A priority for every order, drawn from a network of known weights and a latent of its own."""
    _, model = hand_set_model(spark, folder)
    given = spread(table(spark, folder, "orders")).select("o_orderkey", "o_orderstatus")
    return modelling.generate(given, model, ["o_orderkey"], 1234, sample=True)


@query(
    f"""WITH {_HAND_SQL}, {_ENCODED_SQL}
    SELECT o_orderkey, round(mu + exp(log_var / 2) * {_noise_sql(5)}, 9) AS z FROM latents"""
)
def infer_draws_fixed(spark, folder):
    """A draw of every order's latent by a network of known weights."""
    rows, model = hand_set_model(spark, folder)
    made = modelling.infer(rows, model, ["o_orderkey"], 5, ["o_orderkey"])
    return made.select("o_orderkey", rounded(F.get("z", F.lit(0))).alias("z"))


@query(
    f"""WITH {_HAND_SQL}, {_ENCODED_SQL}, drawn AS (SELECT * EXCLUDE (z, h), mu + exp(log_var / 2) * {_noise_sql(5)} AS z FROM latents),
    {_DECODED_SQL}, weights AS (SELECT t, avg(count(*)) OVER () / count(*) AS w FROM rows GROUP BY t),
    parts AS (SELECT d.o_orderkey, split, w, -ln(p) AS nll, -0.5 * (1 + log_var - mu * mu - exp(log_var)) AS kl
        FROM drawn d JOIN probs p ON p.o_orderkey = d.o_orderkey AND p.token = d.t JOIN weights USING (t)
        JOIN ({_SPLIT_SQL}) s ON s.o_orderkey = d.o_orderkey)
    SELECT split, count(*) AS n, round(0.9::DOUBLE * sum(w * nll) / sum(w) + 0.1::DOUBLE * avg(kl), 9) AS loss,
        round(0.9::DOUBLE * sum(w * nll) / sum(w), 9) AS recon, round(0.1::DOUBLE * avg(kl), 9) AS kld,
        round(sum(w * nll) / sum(w), 9) AS recon_o_orderpriority FROM parts GROUP BY split"""
)
def split_losses_fixed(spark, folder):
    """All losses by split of a network of known weights."""
    rows, model = hand_set_model(spark, folder)
    parts = sample.split(rows, ["o_orderkey"], 1234, 0.1, 0.1)
    return round_doubles(modelling.split_losses(parts, model, ["o_orderkey"], 5))


# For one step of training: latents with so little spread that their noise does not count.
STEP_SET = {**HAND_SET, "var": (0.1, -80.0)}
STEP_RATE = 0.01


def _step_sql():
    """The gradient by every parameter, written out by the chain rule, and one step of Adam by it."""
    s = {n: v if isinstance(v, list) else [f"{x}::DOUBLE" for x in v] for n, v in STEP_SET.items()}
    out_w, out_b = STEP_SET["out0"]
    sums = [f"(SELECT sum(CASE WHEN s = {i} THEN grad_y * {s['label0'][0]} ELSE 0 END) FROM back)" for i in range(3)]
    sums += ["(SELECT sum(y * grad_y) FROM back)", "(SELECT sum(grad_y) FROM back)"]
    sums += [f"(SELECT sum(CASE WHEN t = {i} THEN grad_in ELSE 0 END) FROM back)" for i in range(5)]
    sums += ["(SELECT sum(e * grad_e) FROM back)", "(SELECT sum(grad_e) FROM back)"]
    for head in ("mu", "var"):
        sums += [f"(SELECT sum(h * grad_{head}) FROM back)", f"(SELECT sum(grad_{head}) FROM back)"]
    sums += ["(SELECT sum(mu * grad_h) FROM back)", "(SELECT sum(grad_h) FROM back)"]
    sums += [f"(SELECT sum(k * grad) FROM heads WHERE c = {i})" for i in range(5)]
    sums += [f"(SELECT sum(grad) FROM heads WHERE c = {i})" for i in range(5)]
    start = [*STEP_SET["y0"], *STEP_SET["label0"], *STEP_SET["x0"], *STEP_SET["enc0"], *STEP_SET["mu"]]
    start += [*STEP_SET["var"], *STEP_SET["dec0"], *out_w, *out_b]
    return f"""WITH cells AS (SELECT DISTINCT o_orderstatus, o_orderpriority, month(o_orderdate) AS m FROM orders),
    rows AS (SELECT *, row_number() OVER () AS id, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS s,
        dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS t FROM cells),
    weights AS (SELECT t, avg(count(*)) OVER () / count(*) AS w FROM rows GROUP BY t),
    r1 AS (SELECT *, {STEP_SET["y0"]}[s + 1]::DOUBLE AS y, w / sum(w) OVER () AS share, count(*) OVER () AS n
        FROM rows JOIN weights USING (t)),
    r2 AS (SELECT *, y * {s["label0"][0]} + {s["label0"][1]} AS label FROM r1),
    r3 AS (SELECT *, {STEP_SET["x0"]}[t + 1]::DOUBLE + label AS e FROM r2),
    r4 AS (SELECT *, e * {s["enc0"][0]} + {s["enc0"][1]} AS h FROM r3),
    r5 AS (SELECT *, h * {s["mu"][0]} + {s["mu"][1]} AS mu, h * {s["var"][0]} + {s["var"][1]} AS lv FROM r4),
    r6 AS (SELECT *, mu * {s["dec0"][0]} + {s["dec0"][1]} + label AS k FROM r5),
    scores AS (SELECT id, t, share, k, c, exp(k * {out_w}[c + 1]::DOUBLE + {out_b}[c + 1]::DOUBLE) AS x FROM r6, range(5) a(c)),
    heads AS (SELECT *, (x / sum(x) OVER (PARTITION BY id) - CASE WHEN c = t THEN 1 ELSE 0 END) * share * 0.9::DOUBLE AS grad
        FROM scores),
    b1 AS (SELECT r6.*, grad_h FROM r6 JOIN (SELECT id, sum(grad * {out_w}[c + 1]::DOUBLE) AS grad_h FROM heads GROUP BY id) USING (id)),
    b2 AS (SELECT *, grad_h * {s["dec0"][0]} + 0.1::DOUBLE * mu / n AS grad_mu, 0.05::DOUBLE * (exp(lv) - 1) / n AS grad_var FROM b1),
    b3 AS (SELECT *, grad_mu * {s["mu"][0]} + grad_var * {s["var"][0]} AS grad_e FROM b2),
    b4 AS (SELECT *, grad_e * {s["enc0"][0]} AS grad_in FROM b3),
    back AS (SELECT *, grad_h + grad_in AS grad_y FROM b4),
    steps AS (SELECT unnest(range(0, {len(sums)})) AS "at", unnest({start}::DOUBLE[]) AS old,
        unnest([{", ".join(sums)}]) + 0.01::DOUBLE * unnest({start}::DOUBLE[]) AS g)
    SELECT "at", round(old - {STEP_RATE}::DOUBLE * g / (abs(g) + 1e-8::DOUBLE), 9) AS vector, round(0.1::DOUBLE * g, 9) AS moment,
        round(0.001::DOUBLE * g * g, 9) AS square FROM steps"""


@query(_step_sql())
def train_step_fixed(spark, folder):
    """Parameters and moments after one step of training of a network of known weights, on all kinds of orders."""
    kinds = spread(table(spark, folder, "orders")).select(
        "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("month")
    ).distinct()
    # A few hundred rows, and so a single step.
    rows, model = hand_set_model(spark, folder, kinds, STEP_SET, ["o_orderstatus", "o_orderpriority", "month"])
    model = replace(model, settings=replace(model.settings, lr=STEP_RATE, min_epochs=1, max_epochs=1))
    key = ["o_orderstatus", "o_orderpriority", "month"]
    state = scratch(spark, "step")
    modelling.fit(rows.withColumn("split", F.lit("train")), model, key, 1, state)
    return round_doubles(spark.read.parquet(f"{state}/epoch=0/parameters").drop("best"))


@query("SELECT epoch, epoch < 2 AS resumed, true AS same FROM range(4) r(epoch), (SELECT count(*) FROM orders)")
def resumed_fit(spark, folder):
    """The epochs of a fit that was ended after two and resumed, and whether their losses are those of one in one go."""
    prepared = prepared_orders(spark, folder)
    state = scratch(spark, "epochs")
    two, four = (replace(SETTINGS, min_epochs=n, max_epochs=n) for n in (2, 4))
    _, whole = synthesis.train(prepared, four, 1234)
    synthesis.train(prepared, two, 1234, state)
    _, parts = synthesis.train(prepared, four, 1234, state)
    rows = [
        (a["epoch"], a["resumed"], abs(a["loss"] - b["loss"]) <= 1e-9 * abs(b["loss"]))
        for a, b in zip(parts, whole, strict=True)
    ]
    return spark.createDataFrame(rows, "epoch bigint, resumed boolean, same boolean")


_CONCURRENT_SQL = f"""t AS (SELECT trial, 50000 + {_draw_sql("limit")} * 250000 AS "limit",
        CASE WHEN {_draw_sql("priority")} < 0.5 THEN '1-URGENT' ELSE '5-LOW' END AS priority FROM range(6) r(trial)),
    sides AS (SELECT trial, o_orderstatus AS a, o_orderpriority AS b, 1 AS side FROM orders, t
        UNION ALL SELECT trial, o_orderstatus, CASE WHEN o_totalprice > "limit" THEN priority ELSE o_orderpriority END, -1
        FROM orders, t),
    cells AS (SELECT trial, 1 AS k, 'a' AS combo, a AS x, NULL AS y, sum(side) AS d FROM sides GROUP BY ALL
        UNION ALL SELECT trial, 1, 'b', b, NULL, sum(side) FROM sides GROUP BY ALL
        UNION ALL SELECT trial, 2, 'ab', a, b, sum(side) FROM sides GROUP BY ALL),
    errors AS (SELECT trial, k, combo, avg(abs(d) / (SELECT count(*) FROM orders)::DOUBLE) AS mae FROM cells GROUP BY ALL),
    means AS (SELECT trial, avg(mmae) AS objective FROM (SELECT trial, k, avg(mae) AS mmae FROM errors GROUP BY ALL) GROUP BY trial)"""


@query(
    f"""WITH {_CONCURRENT_SQL} SELECT trial, round("limit", 9) AS "limit", priority, round(objective, 9) AS objective,
        CAST(row_number() OVER (ORDER BY objective, trial) AS INTEGER) AS place FROM t JOIN means USING (trial)"""
)
def concurrent_trials(spark, folder):
    """Trials that run at once, their objectives and ranks: orders against themselves with other priorities above a price."""
    orders = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    target = orders.drop("o_totalprice")

    def score(settings, trial):
        raised = F.when(F.col("o_totalprice") > settings["limit"], settings["priority"]).otherwise(F.col("o_orderpriority"))
        return trials.objective(target, orders.withColumn("o_orderpriority", raised).drop("o_totalprice"))

    tree = {"limit": trials.FloatRange(50_000, 300_000), "priority": trials.Choice(["1-URGENT", "5-LOW"])}
    found = trials.run_trials(spark, tree, score, scratch(spark, "trials"), trials=6, seed=7, workers=4)
    settings = F.col("settings")
    # As many rows as trials.
    place = F.row_number().over(Window.orderBy("objective", "trial"))
    return found.select(
        "trial",
        rounded(settings["limit"].cast("double")).alias("limit"),
        settings["priority"].alias("priority"),
        rounded("objective").alias("objective"),
        place.alias("place"),
    )
