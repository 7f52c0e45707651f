import numpy as np
from pyspark.sql import functions as F
from rasterloom.functions import digest
from rasterloom.sources import script


def by_arrays(data):
    """A message of one chunk, compressed as arrays of one."""
    blocks = max(1, -(-len(data) // 64))
    words, cv = np.frombuffer(data.ljust(64 * blocks, b"\0"), "<u4").reshape(blocks, 16), digest.START[:, None]
    for b in range(blocks):
        last = b == blocks - 1
        flags = (b == 0) * digest.CHUNK_START + last * (digest.CHUNK_END + digest.ROOT)
        cv = digest.compress(cv, words[b][:, None], np.zeros(1, np.int64), np.array([len(data) - 64 * b if last else 64]), np.array([flags]))
    return cv[:, 0].astype("<u4").tobytes()


def test_short_messages():
    data = np.random.default_rng(3).integers(0, 256, 1024, np.uint8).tobytes()
    assert digest.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert all(digest.blake3(data[:n]) == by_arrays(data[:n]) for n in (1, 3, 63, 64, 65, 127, 128, 129, 500, 960, 1023, 1024))


def test_scripts_of_one_file_are_many_tasks(spark):
    rows = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("name"), F.lit("canvas 64 48 background 1").alias("text"))
    plan = script.compiled(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(name" in plan


def test_remembered_digests_are_of_their_own_message(monkeypatch):
    from rasterloom.functions import digest

    message, plain, made = bytes(range(240)) * 5, digest._blake3, []
    monkeypatch.setattr(digest, "_blake3", lambda data: made.append(data) or plain(data))
    first = [digest.blake3(message), digest.blake3(message + b"c"), digest.blake3(message)]
    assert first[0] == first[2] == plain(message) != first[1] and made == [message, message + b"c"]
    assert digest.blake3(bytearray(message)) == first[0]


def test_remembered_holds_so_many():
    from rasterloom.functions.kept import remembered

    made = []
    got = [remembered("test", 2, k, lambda k=k: made.append(k) or k) for k in (1, 2, 1, 3, 2, 1)]
    assert got == [1, 2, 1, 3, 2, 1] and made == [1, 2, 3, 1]


def test_functions_need_no_package_on_the_executors(tmp_path):
    """What travels runs where the package is missing."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    from rasterloom.plans import movies
    from rasterloom.sources import decode, encode, rewrite

    (tmp_path / "f").write_bytes(cloudpickle.dumps((movies.movie, encode.swept, decode.decode, rewrite.collapsed)))
    code = "import pickle, sys; m, s, d, r = pickle.load(open('f', 'rb')); assert all(len(list(d(r(s(m(k, k))[0])))) == 6 for k in (1, 5, 13)) and 'rasterloom' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, check=True)
