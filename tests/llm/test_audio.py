import hashlib
import zlib

import numpy as np
import pyarrow as pa

from voxelmill.llm import audio

DOCS = "doc_id long, text string, media string, stored string"


def test_wav_round_trip():
    for n in (0, 1, 575, 576, 577, 5000):
        payload, raw = audio.payload_of("é" * (n // 2) + "x" * (n % 2))
        assert raw == n and len(payload) % 576 == 0 and len(payload) > 0 and audio.decode_wav(audio.encode_wav(payload)) == payload


def test_resampling_keeps_a_tone():
    t = np.arange(5760) / audio.RATE
    y = audio.resample(np.sin(2 * np.pi * 440 * t))
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / audio.OUT_RATE)
    assert len(y) == 3840
    best = max(np.corrcoef(y[100 + s : 3700 + s], want[100:3700])[0, 1] for s in range(-4, 5))
    assert best > 0.99
    high = audio.resample(np.sin(2 * np.pi * 5500 * t))
    assert np.abs(high[100:-100]).max() < 0.1  # above the new Nyquist rate


def test_log_mel_against_a_plain_transform():
    y = np.random.default_rng(0).normal(size=128 * 9)
    mels, energy = audio.log_mel(y)
    padded = np.r_[y, np.zeros(256)]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(256), np.arange(129)) / 256)
    for f in range(9):
        x = padded[f * 128 : f * 128 + 256] * window
        assert np.allclose(mels[f], np.log(np.abs(x @ basis) ** 2 @ audio.mel_bank() + 1e-6))
        assert np.isclose(energy[f], np.log((x * x).sum() + 1e-6))


def test_hysteresis_against_a_loop():
    rng = np.random.default_rng(2)
    doc = np.repeat(np.arange(5), [1, 7, 60, 3, 200])
    energy = rng.normal(size=len(doc)).cumsum()
    want = []
    for d in range(5):
        e = energy[doc == d]
        mean, dev, on = e.mean(), e.std(), False
        for v in e:
            on = True if v >= mean + 0.5 * dev + 1e-6 else False if v < mean else on
            want.append(on)
    assert (audio.hysteresis(energy, doc) == want).all()


def test_values_do_not_depend_on_neighbours(monkeypatch):
    payloads = [audio.payload_of(t)[0] for t in ("", "abc " * 300, "é" * 9000, "z")]
    together = [audio.summary(*r) for r in audio.analyse(payloads)]
    assert together == [audio.summary(*audio.analyse([p])[0]) for p in payloads]
    monkeypatch.setattr(audio, "CHUNK", 1)
    assert together == [audio.summary(*r) for r in audio.analyse(payloads)]


def test_query_and_tensors(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = audio.query(spark, sf).collect()
    assert len(got) == len(texts)
    features = {}
    for r in got:
        payload, n = audio.payload_of(texts[r["doc_id"]])
        wav = audio.encode_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (n, len(payload), len(wav))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(wav).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert features.setdefault(texts[r["doc_id"]], r["feature"]) == r["feature"]
    rows = [(1, "speech " * 2000, "a", "b"), (None, None, None, None), (2, "", None, None), (1, "speech " * 2000, "a", "b")]
    df = spark.createDataFrame(rows, DOCS)
    made = audio.media_table(df).collect()
    assert sorted(str(r["doc_id"]) for r in made) == ["1", "1", "2", "None"]
    table = audio.read_tensors(made[0]["tensors"])
    assert table["values"].type == pa.fixed_shape_tensor(pa.float32(), (32, 24), dim_names=("frame", "band"))
    assert table["values"].combine_chunks().to_numpy_ndarray().shape == (table.num_rows, 32, 24)
    assert table["start"].to_pylist()[1:] == table["end"].to_pylist()[:-1]
    assert audio.media_table(df.limit(0)).count() == 0 == audio.digests(audio.media_table(df.limit(0))).count()


def test_the_query_reads_its_feature_from_tensors(spark, tmp_path, monkeypatch):
    texts = ["ab é " * k for k in (0, 1, 300, 2_000, 9_000, 100_000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [audio.summary(*r) for r in audio.analyse([audio.payload_of(t)[0] for t in texts])]
    monkeypatch.setattr(audio, "SLICE", 5_000)  # slices of several rows, and of one that is larger
    audio.query(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out.parquet")
    for r in spark.read.parquet(f"{tmp_path}/out.parquet").collect():
        assert r["feature"] == want[r["doc_id"]] == audio.summary(*audio.read_frames(r["tensors"], r["segments"]))
        assert audio.read_tensors(r["tensors"])["values"].type == audio.TENSOR


def test_slices():
    sizes = np.array([3, 3, 9, 0, 0, 5, 5])
    assert list(audio._slices(sizes, 6)) == [(0, 2), (2, 3), (3, 6), (6, 7)] and list(audio._slices(sizes[:0], 6)) == []
