"""Topic model: uniform model perplexity, window counts against brute force, fit."""
import math

from pyspark.sql import functions as F

from quill.operators import coherence as CH
from quill.operators import topics as TM


def test_uniform_model_perplexity_is_vocab_size(spark):
    V, H, K = 30, 4, 3
    params = TM.init_params(spark, V, H, K).withColumn(
        "values", F.when(F.col("layer").isin("dec", "dec_b"), F.transform("values", lambda x: x * 0.0)).otherwise(F.col("values")))
    bow = spark.createDataFrame([(1, 3, 2), (1, 7, 1), (2, 0, 5)], "doc_id long, token_id int, cnt int")
    ppl = TM.perplexity(bow, params).first()["perplexity"]
    assert abs(ppl - V) < 1e-9


def test_window_counts_equal_brute_force(spark):
    width = 4
    texts = {1: "a b c a d e f g a".split(), 2: "b a".split(), 3: "x y z".split(), 4: "a b a b a b a b a b".split()}
    rows = [(d, p, t) for d, ts in texts.items() for p, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, token string")
    words = spark.createDataFrame([("a",), ("b",)], "token string")
    got = {(r["doc_id"], r["token"]): r["windows"] for r in CH.sliding_window_counts(df, words, width).collect()}
    for d, ts in texts.items():
        wins = [ts[s:s + width] for s in range(max(len(ts) - width + 1, 1))]
        for w in ("a", "b"):
            n = sum(1 for win in wins if w in win)
            if n:
                assert got[(d, w)] == n


def test_always_together_words_are_coherent(spark):
    texts = {d: ("a b " * 3).split() + ["c"] * d for d in range(1, 6)}
    rows = [(d, p, t) for d, ts in texts.items() for p, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, token string")
    top = spark.createDataFrame([(0, "a"), (0, "b")], "topic int, token string")
    c = CH.coherence_cv(top, df, width=110).first()["coherence"]
    assert abs(c - 1.0) < 1e-9


def test_fit_loss_falls(spark):
    rows = [(d, t, 1 + (d * t) % 3) for d in range(40) for t in range(d % 5, 20, 3)]
    bow = spark.createDataFrame(rows, "doc_id long, token_id int, cnt int")
    _, log, _ = TM.fit(bow, 20, H=8, K=3, epochs=4, batch_size=20, lr=0.05)
    s = TM.training_log_summary(log).orderBy("epoch").collect()
    assert s[-1]["avg_loss"] < s[0]["avg_loss"]
    assert not any(math.isnan(r["avg_loss"]) for r in s)


def test_blocks_of_a_large_model_give_the_same(spark, monkeypatch):
    import random
    import numpy as np
    from quill.operators import topics as TM
    r = random.Random(1)
    bow = spark.createDataFrame([(d, t, r.randint(1, 3)) for d in range(23) for t in sorted(r.sample(range(37), r.randint(1, 9)))],
                                "doc_id long, token_id int, cnt int")
    params = TM.init_params(spark, 37, 6, 4)
    whole = sorted(TM.forward(bow, params).collect(), key=lambda x: x["doc_id"])
    m = TM.Model(TM.params_to_numpy(params))
    for x in whole:
        _, lp = m.log_probs(np.array([x["mu"]]))
        assert np.allclose(x["logps"], lp[0, x["token_ids"]])
    for name, value in (("BROADCAST_PARAMS", 100), ("VOCAB_BLOCK", 10), ("SLICE_DOCS", 9), ("DOC_SLICE", 4)):
        monkeypatch.setattr(TM, name, value)
    parts = sorted(TM._forward_blocks(bow, params).collect(), key=lambda x: x["doc_id"])
    assert [x["doc_id"] for x in parts] == [x["doc_id"] for x in whole]
    for a, b in zip(whole, parts):
        assert np.allclose(a["mu"], b["mu"]) and np.allclose(a["logvar"], b["logvar"])
        assert sorted(zip(a["token_ids"], a["cnts"])) == sorted(zip(b["token_ids"], b["cnts"]))
        assert np.allclose([p for _, p in sorted(zip(a["token_ids"], a["logps"]))], [p for _, p in sorted(zip(b["token_ids"], b["logps"]))])


def _large(monkeypatch):
    for name, value in (("BROADCAST_PARAMS", 100), ("VOCAB_BLOCK", 10), ("SLICE_DOCS", 9), ("DOC_SLICE", 4), ("BLOCK_BYTES", 400)):
        monkeypatch.setattr(TM, name, value)


def _blocks_case(spark):
    import random
    r = random.Random(3)
    bow = spark.createDataFrame([(d, t, r.randint(1, 3)) for d in range(23) for t in sorted(r.sample(range(37), r.randint(1, 9)))],
                                "doc_id long, token_id int, cnt int")
    docs = spark.createDataFrame([(d,) for d in [*range(23), 5, 900, None]], "doc_id long")  # one twice, two without a counted token
    return bow, docs, TM.init_params(spark, 37, 6, 4)


def test_blocks_give_the_losses_of_the_whole_model(spark, monkeypatch):
    """One row per row of ``docs``, whatever the model's size."""
    bow, docs, params = _blocks_case(spark)

    def all_of():
        return [sorted((str(r["doc_id"]), *[round(x, 9) + 0.0 for x in r[1:]]) for r in TM.elbo(bow, params, docs).collect()),
                sorted((str(r["doc_id"]), [round(x, 9) for x in r["mu"] + r["logvar"]]) for r in TM.encode(bow, params, docs).collect()),
                sorted((r["doc_id"], r["token_id"], r["cnt"], round(r["logp"], 9)) for r in TM.word_logp(bow, params, docs).collect()),
                [round(x, 9) for x in TM.perplexity(bow, params).first()]]

    whole = all_of()
    _large(monkeypatch)
    assert all_of() == whole
    assert len(whole[0]) == len(whole[1]) == 26


def test_encoding_does_not_read_the_decoder(spark, monkeypatch):
    bow, docs, params = _blocks_case(spark)
    _large(monkeypatch)
    decoder = (F.col("layer") == "dec_b") | ((F.col("layer") == "dec") & (F.col("row") > 0))  # the first row tells the width
    broken = F.when(decoder, F.transform("values", lambda x: F.raise_error(F.lit("read")).cast("double"))).otherwise(F.col("values"))
    got = TM.encode(bow, params.withColumn("values", broken), docs).collect()
    assert len(got) == 26


def test_softmax_sums_of_near_and_far_logits():
    import numpy as np
    r = np.random.default_rng(5)
    Z, W, shift = r.normal(size=(150, 3)), r.normal(size=(5000, 3)), r.normal(size=5000)
    Z[::7] *= 900  # logits that lie beyond what an exponential can hold
    mx, total = TM.softmax_sums(Z, W, shift)
    y = Z @ W.T + shift
    top = y.max(1)
    assert np.allclose(mx + np.log(total), top + np.log(np.exp(y - top[:, None]).sum(1)), rtol=1e-13, atol=1e-12)


def test_the_grid_of_a_large_model_grows_with_the_data():
    """What is sent (documents to every block, rows to every slice) is within a
    factor of the data, not blocks of fixed size times documents."""
    for docs, rows, width in ((5_000, 800_000, 64), (50_000, 3_700_000, 64), (500_000, 3_700_000, 40)):
        blocks, slices = TM._grid(docs, width, rows, width, 24)
        assert rows * width * 8 / blocks <= TM.BLOCK_BYTES and docs / slices <= TM.SLICE_DOCS
        assert docs * blocks + rows * slices <= 12 * (docs + rows)


def test_fit_by_blocks_is_adam_on_the_whole_model(spark, monkeypatch):
    """A model beyond what the driver may hold, in blocks, and a document without words, against dense NumPy."""
    import numpy as np
    n, V, H, K, lr = 11, 23, 5, 3, 0.01
    rows = [(d, t, 1 + (d * t) % 3) for d in range(1, n) for t in range(d % 5, V, 3)]
    bow = spark.createDataFrame(rows, "doc_id long, token_id int, cnt int")
    docs = spark.createDataFrame([(d,) for d in range(n)], "doc_id long")
    start = TM.init_params(spark, V, H, K)
    p = TM.params_to_numpy(start)
    monkeypatch.setattr(TM, "FIT_PARAMS", 100)
    monkeypatch.setattr(TM, "FIT_BLOCK", 2)
    monkeypatch.setattr(TM, "FIT_TASK_BYTES", 12 * 9 * 8)  # three tasks
    got, log, _ = TM.fit(bow, V, epochs=2, batch_size=4, lr=lr, params=start, docs=docs)
    m1, m2, want, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, [], 0
    for epoch in range(2):
        of = {}
        for r in TM.minibatches(docs, epoch, 4).collect():
            of.setdefault(r["batch"], []).append(r["doc_id"])
        for b in sorted(of):
            ids, step = sorted(of[b]), step + 1
            X = np.array([[next((c for d, t, c in rows if (d, t) == (i, v)), 0) for v in range(V)] for i in ids], dtype=float)
            a = X @ p["enc"] + p["enc_b"]
            h = np.maximum(a, 0)
            mu, lv = h @ p["mu"] + p["mu_b"], h @ p["lv"] + p["lv_b"]
            eps = np.stack([TM.noise(42, epoch, i, K) for i in ids])
            z = mu + eps * np.exp(lv / 2)
            e = np.exp(z @ p["dec"].T + p["dec_b"])
            sm = e / e.sum(1, keepdims=True)
            want.append((epoch, b, len(ids), (-(X * np.log(sm)).sum(1) - 0.5 * (1 + lv - mu**2 - np.exp(lv)).sum(1)).mean()))
            dl = (X.sum(1, keepdims=True) * sm - X) / len(ids)
            dz = dl @ p["dec"]
            dmu, dlv = dz + mu / len(ids), dz * eps * np.exp(lv / 2) / 2 + (np.exp(lv) - 1) / 2 / len(ids)
            da = (dmu @ p["mu"].T + dlv @ p["lv"].T) * (a > 0)
            g = {"enc": X.T @ da, "enc_b": da.sum(0), "mu": h.T @ dmu, "mu_b": dmu.sum(0), "lv": h.T @ dlv, "lv_b": dlv.sum(0), "dec": dl.T @ z, "dec_b": dl.sum(0)}
            for k in p:
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g[k], 0.999 * m2[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - lr * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    have = sorted((r["epoch"], r["batch"], r["docs"], r["loss"]) for r in log.collect())
    assert [x[:3] for x in have] == [x[:3] for x in want] and np.allclose([x[3] for x in have], [x[3] for x in want], rtol=1e-4)
    have = TM.params_to_numpy(got, 10**6)
    assert have.keys() == p.keys() and all(np.allclose(have[k], p[k], atol=2e-3) and np.abs(have[k] - p[k]).mean() < 1e-4 for k in p)


def test_registered_fits_are_whole(spark, monkeypatch):
    """The reference's sizes, on the balanced train rows; train_head on as many rows of every class."""
    from quill.plans import catalog
    from tests.conftest import SF_SMALL
    seen = {}
    monkeypatch.setattr(catalog.TM, "fit", lambda bow, V, **kw: (None, seen.update(kw, bow=bow), None))
    catalog._fit(spark, SF_SMALL)
    assert (seen["H"], seen["K"], seen["epochs"], seen["batch_size"]) == (500, 40, 15, 64)
    balanced = catalog.QUERIES["balanced_distribution"](spark, SF_SMALL).agg(F.sum("n")).first()[0]
    assert seen["docs"].distinct().count() == balanced
    assert seen["bow"].select("doc_id").distinct().join(seen["docs"], "doc_id", "left_anti").count() == 0
    monkeypatch.setattr(catalog.CL, "fit_softmax_head", lambda train, lmap: 1 / 0 if seen.update(head=train) else 1 / 0)
    try:
        catalog.q_train_head(spark, SF_SMALL)
    except ZeroDivisionError:
        pass
    assert len({r["count"] for r in seen["head"].groupBy("label").count().collect()}) == 1


def test_documents_without_words_are_encoded(spark, monkeypatch):
    bow = spark.createDataFrame([(d, t, 1 + t % 2) for d in range(1, 8) for t in range(d, 20, 4)], "doc_id long, token_id int, cnt int")
    docs = spark.createDataFrame([(d,) for d in range(9)], "doc_id long")
    params = TM.init_params(spark, 20, 4, 3)
    by = lambda df: {r["doc_id"]: (r["recon"], r["kl"], r["loss"]) for r in df.collect()}
    whole, some = by(TM.elbo(bow, params, docs)), by(TM.elbo(bow, params))
    assert set(whole) == set(range(9)) and {d: whole[d] for d in some} == some
    assert whole[0] == whole[8] and whole[0][0] == 0 and whole[0][1] > 0
    for name, value in (("BROADCAST_PARAMS", 100), ("VOCAB_BLOCK", 10), ("SLICE_DOCS", 4), ("DOC_SLICE", 4)):
        monkeypatch.setattr(TM, name, value)
    parts = by(TM.elbo(bow, params, docs))
    assert set(parts) == set(whole) and all(abs(a - b) < 1e-9 for d in whole for a, b in zip(whole[d], parts[d]))


def test_every_split_has_its_encoding(spark, monkeypatch):
    from quill.plans import catalog
    from tests.conftest import SF_SMALL
    made = catalog._topic_setup(spark, SF_SMALL)
    monkeypatch.setattr(catalog, "_topic_setup", lambda *a: made)
    q, docs = catalog.QUERIES, {(r["doc_id"], r["split"]) for r in made[0].docs.collect()}
    e = q["topic_encode_splits"](spark, SF_SMALL).collect()
    assert {(r["doc_id"], r["split"]) for r in e} == docs and len(e) == 40 * len(docs) and all(r["logvar"] is not None for r in e)
    assert {(r["doc_id"], r["dim"], r["mu"]) for r in q["topic_encode"](spark, SF_SMALL).collect()} == {(r["doc_id"], r["dim"], r["mu"]) for r in e if r["split"] == "val"}
    assert {r["split"] for r in q["topic_word_logp_splits"](spark, SF_SMALL).select("split").distinct().collect()} == {"train", "val", "test"}
    assert q["elbo_loss_splits"](spark, SF_SMALL).count() == len(docs)
    assert sum(r["n_docs"] for r in q["elbo_mean"](spark, SF_SMALL).collect()) == sum(s == "train" for _, s in docs)


def test_a_stopped_fit_goes_on(spark, tmp_path, monkeypatch):
    """A driver lost before an epoch's marker: the next run takes up moments, heads and draws, and ends alike."""
    import numpy as np
    import pytest
    from quill.sources.versions import Versions
    bow = spark.createDataFrame([(d, t, 1 + (d * t) % 3) for d in range(30) for t in range(d % 5, 20, 3)], "doc_id long, token_id int, cnt int")
    vocab = spark.createDataFrame([(f"w{t}", t) for t in range(20)], "token string, token_id int")
    monkeypatch.setattr(TM, "FIT_TASK_BYTES", 12 * 10 * 10)  # two tasks
    args = dict(V=20, H=6, K=3, epochs=3, batch_size=8, lr=0.05, vocab=vocab, monitor_topics=2, monitor_words=3)
    whole = TM.fit(bow, root=str(tmp_path / "a"), **args)
    commit = Versions.commit

    def lost(self, epoch, log):
        if epoch == 1:
            raise RuntimeError("lost")
        commit(self, epoch, log)

    monkeypatch.setattr(Versions, "commit", lost)
    with pytest.raises(RuntimeError):
        TM.fit(bow, root=str(tmp_path / "b"), **args)
    monkeypatch.setattr(Versions, "commit", commit)
    assert Versions(spark, str(tmp_path / "b")).last() == 0
    again = TM.fit(bow, root=str(tmp_path / "b"), **args)
    rows = lambda df: np.array(sorted(map(tuple, df.collect())))
    assert np.allclose(rows(whole[1]), rows(again[1])) and len(rows(again[1])) == 12
    assert sorted(map(tuple, whole[2].collect())) == sorted(map(tuple, again[2].collect())) and again[2].count() == 18
    a, b = (TM.params_to_numpy(x[0]) for x in (whole, again))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    epoch, best = TM.best_params(Versions(spark, str(tmp_path / "b")))
    means = {r["epoch"]: r["avg_loss"] for r in TM.training_log_summary(again[1]).collect()}
    assert epoch == min(means, key=means.get)
    assert epoch != 2 or all(np.allclose(TM.params_to_numpy(best)[k], a[k]) for k in a)


def test_numbers_drawn_in_numpy_are_those_of_spark(spark):
    import numpy as np
    from quill.functions.hashing import draws_of, hash_draw
    i = [*range(12), 99, 100, 16384, 16385, 10**9 - 1, 10**9, 2**40]
    df = spark.createDataFrame([(x,) for x in i], "i long").select(hash_draw(42, "dec", F.col("i")).alias("h"))
    assert draws_of(42, "dec", np.array(i)).tolist() == [r["h"] for r in df.collect()]


def test_parameters_and_their_rule_are_the_hashed_weights(spark):
    """Each weight as the SQL twin has it, bit for bit, whether from the table or made for a task."""
    import numpy as np
    from quill.functions.hashing import hash_unit
    V, H, K = 23, 6, 4
    params, p = TM.init_params(spark, V, H, K), TM.params_to_numpy(TM.init_params(spark, V, H, K))
    for layer, (rows, cols, fan_in) in TM._shapes(V, H, K).items():
        i = spark.range(rows * cols).select("id", ((hash_unit(42, layer, F.col("id")) - F.lit(0.5)) * F.lit(2.0 * (1.0 / math.sqrt(fan_in)))).alias("w"))
        assert p[layer].ravel().tolist() == [r["w"] for r in i.orderBy("id").collect()]
    rule, some = TM._rule(params), np.array([3, 22, 0, 11])
    assert (rule.rows("enc", some) == p["enc"][some]).all()
    assert (rule.decoder(some) == np.concatenate([p["dec"], p["dec_b"].T], axis=1)[some]).all()
    assert TM._rule(params.where("row >= 0")) is None  # another table


def test_moments_give_a_softmax_its_sum_or_nothing():
    """Within the bound that is asked for, and no number where the bound is not met."""
    import numpy as np
    r = np.random.default_rng(8)
    rows = np.concatenate([r.uniform(-.3, .3, size=(5000, 6)), r.normal(size=(5000, 1))], axis=1)
    centre = r.normal(size=6)
    Z = centre + r.normal(size=(300, 6)) * np.repeat([1e-3, 0.05, 2, 400], 75)[:, None]
    halves = [TM._Moments.of_rows([x], centre) for x in (rows[:3000], rows[3000:])]
    top, norm, G = TM._Moments.of_rows([rows[:3000], rows[3000:]], centre)
    best = max(h[0] for h in halves)
    assert np.allclose(sum(h[2] * np.exp(h[0] - best) for h in halves) * np.exp(best - top), G)
    got = TM._Moments(centre, top, norm, G).log_sums(Z, 1e-7)
    y = Z @ rows[:, :6].T + rows[:, 6]
    true = y.max(1) + np.log(np.exp(y - y.max(1)[:, None]).sum(1))
    known = ~np.isnan(got)
    assert known[:75].all() and 0 < known[75:150].sum() and not known[150:].any()
    assert np.abs(got - true)[known].max() < 1e-7 and np.abs(got - true)[:75].max() < 1e-12


def test_moments_in_the_passes_of_a_large_model(spark, monkeypatch):
    """By moments, and one far document by all rows, for a model with and without a rule: the same losses."""
    bow, docs, params = _blocks_case(spark)
    bow = bow.withColumn("cnt", F.when(F.col("doc_id") == 4, F.col("cnt") * 9000).otherwise(F.col("cnt")))
    by = lambda df: sorted((str(r["doc_id"]), round(r["recon"], 6), round(r["kl"], 6)) for r in df.collect())
    lp = lambda df: sorted((r["doc_id"], r["token_id"], r["cnt"], round(r["logp"], 6)) for r in df.collect())
    whole, words = by(TM.elbo(bow, params, docs)), lp(TM.word_logp(bow, params, docs))
    _large(monkeypatch)
    monkeypatch.setattr(TM, "MOMENT_DOCS", 0)
    monkeypatch.setattr(TM, "MOMENT_ERROR", 1e-3)
    # moments about the mean, which a far document draws away: about the others here
    kept, seen, moments = TM._grid, [], TM._moments
    monkeypatch.setattr(TM, "_grid", lambda n, *a: seen.append(n) or kept(n, *a))
    monkeypatch.setattr(TM, "_moments", lambda dec, rule, z, K, tasks: moments(dec, rule, z.where("key <> 4"), K, tasks))
    for p in (params, params.where("row >= 0")):
        got = by(TM.elbo(bow, p, docs))
        assert [x[::2] for x in got] == [x[::2] for x in whole] and all(abs(a[1] - b[1]) < 1e-2 for a, b in zip(got, whole))
    assert seen == [1, 1] and [x for x in got if x[0] == "4"] == [x for x in whole if x[0] == "4"]
    assert got != whole  # moments were used: the bound asked for here is coarse
    monkeypatch.setattr(TM, "MOMENT_ERROR", 0.0)
    assert lp(TM.word_logp(bow, params, docs)) == words and seen[2:] == [23]


def test_a_slice_reads_its_entries_once(spark, monkeypatch):
    """Neither documents nor rows of the model are copied to blocks or slices: of a model with a rule only entries and ids are shuffled."""
    bow, docs, params = _blocks_case(spark)
    whole = sorted((str(r["doc_id"]), [round(x, 9) for x in r["mu"]]) for r in TM.encode(bow, params, docs).collect())
    _large(monkeypatch)
    kept, seen = TM._sliced, []
    monkeypatch.setattr(TM, "_sliced", lambda *a: seen.append(kept(*a)) or seen[-1])
    assert sorted((str(r["doc_id"]), [round(x, 9) for x in r["mu"]]) for r in TM.encode(bow, params, docs).collect()) == whole
    assert seen[0].count() == bow.count() + 23 and "values" not in seen[0].columns
    TM.encode(bow, params.where("row >= 0"), docs).count()
    rows = seen[1].where("values is not null")
    assert rows.count() == rows.select("token_id", F.spark_partition_id()).distinct().count()


def test_a_counted_token_beyond_the_model_is_an_error(spark, monkeypatch):
    import pytest
    bow, _, params = _blocks_case(spark)
    _large(monkeypatch)
    with pytest.raises(Exception, match="no row in the model"):
        TM.encode(bow.unionByName(spark.createDataFrame([(1, 37, 1)], bow.schema)), params.where("row >= 0")).count()


def test_a_task_of_the_fit_holds_its_rows_once():
    """Chunks go to their place as they come, in any order; nothing beside the weights and moments is held."""
    import tracemalloc
    import numpy as np
    rows, width = 5000, 100
    made = [np.arange(k * 1000 * width, (k + 1) * 1000 * width, dtype=np.float32) for k in range(5)]
    tracemalloc.start()
    shard = TM._Shard(rows, width)
    for k in (3, 0, 4, 1, 2):
        shard.put(k * 1000, *[(made[k] * f).tobytes() for f in (1, 2, 3)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (shard.w.ravel() == np.arange(rows * width)).all() and (shard.v == 3 * shard.w).all() and (shard.m == 2 * shard.w).all()
    assert peak < 1.5 * 3 * rows * width * 4


def test_a_fit_reads_few_chunks_at_a_time(spark, monkeypatch):
    """A frame of the state is some chunks, not the task's model; the setting is as before afterwards."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, kept = spark.conf.get(key, None), TM.Versions.write
    monkeypatch.setattr(TM.Versions, "write", lambda self, kind, *a: seen.append((kind, spark.conf.get(key, None))) or kept(self, kind, *a))
    bow = spark.createDataFrame([(d, t, 1) for d in range(6) for t in range(d % 3, 9, 2)], "doc_id long, token_id int, cnt int")
    TM.fit(bow, 9, H=3, K=2, epochs=1, batch_size=4)
    assert ("state", str(TM.FIT_ROWS)) in seen and spark.conf.get(key, None) == before
