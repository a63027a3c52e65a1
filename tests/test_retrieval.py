import hashlib
import random
import re

from pyspark.sql import functions as F

from skein.functions.text import without_contacts
from skein.operators import retrieval
from skein.plans import record_queries


def test_hamming_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(12)]
    bits = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base] + base[:3]
    df = spark.createDataFrame([(i, i % 2, b) for i, b in enumerate(bits)], "k bigint, block int, bits bigint")
    got = {(r.a, r.b, r.distance) for r in retrieval.hamming_pairs(df, "k", "block", "bits").collect()}
    first = {}
    for i, b in enumerate(bits):
        first.setdefault((i % 2, b), i)
    want = {(min(x, y), max(x, y), (a ^ b).bit_count()) for (p, a), x in first.items() for (q, b), y in first.items() if p == q and x < y and (a ^ b).bit_count() <= 8}
    assert got == want and want


def test_hamming_pairs_with_a_bit_off_in_every_byte(spark):
    rng = random.Random(5)
    bits = [rng.getrandbits(64) - (1 << 63) for _ in range(6)]
    bits += [b ^ sum(1 << (8 * i + rng.randrange(7)) for i in range(8)) for b in bits]
    df = spark.createDataFrame([(i, 0, b) for i, b in enumerate(bits)], "k bigint, block int, bits bigint")
    got = {(r.a, r.b, r.distance) for r in retrieval.hamming_pairs(df, "k", "block", "bits").collect()}
    assert got >= {(i, i + 6, 8) for i in range(6)}


def plain_simhash(text):
    t = re.sub("[和及与]", "", re.sub(r"[\s\W_]+", "", text.lower()))
    if not t:
        return 0
    weights = [0] * 64
    for g in [t[i : i + 2] for i in range(max(1, len(t) - 1))]:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
        weights = [w + (1 if h >> k & 1 else -1) for k, w in enumerate(weights)]
    return sum(1 << k for k, w in enumerate(weights) if w >= 0)


def test_simhash64(spark):
    texts = ["负责推荐系统与特征平台的建设。", "Build the feature store, and run it_well", "", "——", "a", "和", None, "İstanbul 数据", "𠮷野家"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.h for r in df.select("i", retrieval.simhash64(F.col("t")).alias("h")).collect()}
    assert got.pop(6) is None
    assert {i: h % (1 << 64) for i, h in got.items()} == {i: plain_simhash(t) for i, t in enumerate(texts) if t is not None}


def test_text_simhash_clusters_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/jobs.parquet").where("job_description_raw IS NOT NULL").select("row_id", "job_family_id", "job_description_raw").collect()
    sign = {r.row_id: plain_simhash(r.job_description_raw) for r in rows}
    parent = {i: i for i in sign}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a in rows:
        for b in rows:
            if a.row_id < b.row_id and a.job_family_id == b.job_family_id and (sign[a.row_id] ^ sign[b.row_id]).bit_count() <= 8:
                parent[find(a.row_id)] = find(b.row_id)
    want = {}
    for i in sign:
        want.setdefault(find(i), set()).add(i)
    got = {}
    for r in record_queries.text_simhash_clusters(spark, sf).collect():
        got.setdefault(r.master, set()).add(r.row_id)
        assert r.members == len(want[find(r.row_id)])
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1) and got
    assert all(m in c for m, c in got.items())
    score = {r.row_id: r.quality_score or 0.0 for r in spark.read.parquet(f"{sf}/jobs.parquet").collect()}
    assert all(score[m] == max(score[i] for i in c) for m, c in got.items())


def test_lexical_tokens_of_chinese_runs(spark):
    texts = ["负责推荐系统", "熟悉Python/C++与数据仓库", "好", "", "岗位要求：熟悉 K8s", "\u212a8s 数据，数据", "——"]

    def plain(text):
        out = set()
        for run in re.findall(r"[A-Za-z0-9+#./-]+|[\u4e00-\u9fff]{2,}", text):
            out |= {run.lower()} if run.isascii() else {run[i : i + n] for n in range(2, 7) for i in range(len(run) - n + 1)}
        return sorted(out - set(retrieval.STOP_TOKENS), key=lambda t: (-len(t), t))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", retrieval.lexical_tokens(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [plain(t) for t in texts] and "推荐系统" in got[0] and "负责" not in got[0]


def test_contacts_are_redacted(spark):
    label = "(?:联系人|联系电话|联系地址|通讯地址|详细地址|电子邮箱|邮箱|电话|手机|联系方式)"

    def plain(text):
        lines = [x for x in text.split("\n") if not re.match(rf"^\s*{label}\s*[:：]", x)]
        for p in (rf"{label}\s*[:：].*$", r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])", r"(?<!\d)1[3-9]\d{9}(?!\d)", r"(?<!\d)0\d{2,3}[- ]?\d{7,8}(?!\d)"):
            lines = [re.sub(p, "[REDACTED]", x) for x in lines]
        return re.sub(r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n", "\n".join(lines).strip(" \t\n"))

    texts = [
        "岗位职责\n联系人：王老师\n　电话 : 010-12345678\n\n\n\n要求", "投递请联系电话：021 87654321 王\r\n其他", "有意者致电13812345678或 0571-88888888。", "邮箱a.b+c@example.com.cn，王@x.org", "编号213812345678901 与 ２０２５",
        "", "\n\n", "联系方式\n：不是一行", "mail x@y.z1 or x@y.zz-", "电话：\r尾\u2028巴", "a\n \n\t\nb", "x_王é@ab.co\n010 1234567 8",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", without_contacts(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [plain(t) for t in texts]
    assert got[0] == "岗位职责\n\n要求" and got[2] == "有意者致电[REDACTED]或 [REDACTED]。"
