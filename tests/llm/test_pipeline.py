import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from usageloom.llm import line_dedup
from usageloom.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"


def plain_tokens(text):
    """Lower-cased words without ASCII signs."""
    return re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", text.lower()).encode().split()


def plain_leaks(text, items):
    """Whether greedy string tiling covers half of any item, by trying every pair of places."""
    from test_text_dedup import plain_tiles

    words = plain_tokens(text)
    windows = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for item in items:
        if len(item) < 5 or not any(tuple(item[i : i + 5]) in windows for i in range(len(item) - 4)):
            continue
        # Words outside the item part tiles; a run of them parts like one.
        known = {word: n for n, word in enumerate(dict.fromkeys(item))}
        own = []
        for word in words:
            if word in known or (own and own[-1] >= 0):
                own.append(known.get(word, -1))
        if plain_tiles([known[w] for w in item], own, 5) >= 0.5 * len(item):
            return True
    return False


def test_run_equals_the_stages_by_brute_force(spark):
    from test_near_dedup import plain_groups
    from test_text_dedup import plain_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    kept = [(d.doc_id, d.text) for d in docs if re.search(r"[^\W\d_]", d.text or "")]
    lines = plain_lines(kept, line_dedup.MIN_WORDS)
    kept = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(lines[d, t]))) for d, t in kept]
    chosen = set(plain_groups(kept))
    kept = [(d, t) for d, t in kept if d in chosen]
    items = [plain_tokens(b.text) for b in benchmark]
    kept = [(d, t) for d, t in kept if not plain_leaks(t, items)]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for d, text in kept:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at : at + 4096]
            want.append((d, n, at, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        ends = [0, *[a + n for a, n in sorted(places)]]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096


def test_near_dedup_stage_takes_pairs_that_fingerprints_miss(spark):
    """On the given documents, pairs at 0.8 or more are beyond four fingerprint bits too."""
    from test_near_dedup import plain_shingles
    from usageloom.llm import simhash

    rows = [(d.doc_id, d.text or "") for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = [plain_shingles(t) for _, t in rows]
    near = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    missed = [(i, j) for i, j in near if (prints[i] ^ prints[j]).bit_count() > simhash.RADIUS]
    assert near and missed
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert all(not {rows[i][0], rows[j][0]} <= left for i, j in near)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()


def test_stages_hold_little_at_once(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    text = F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("plain words "), 17_000))
    docs = spark.range(150).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    staged = corpus_pipeline.identify_language(spark, docs, SF).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    # 200 kB a text: 30 MB in all.
    assert max(r.rows for r in docs.coalesce(1).mapInArrow(sizes, "rows long").collect()) <= 11
    staged.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/out")
    (file,) = tmp_path.glob("out/part-*")
    assert pq.ParquetFile(file).metadata.num_row_groups > 1
    assert spark.read.parquet(f"{tmp_path}/out").count() == 150
