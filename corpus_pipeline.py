"""A corpus pipeline of five training-data stages, each written as Parquet and read again.

Every stage works on all rows its predecessor kept, and its decisions take effect: documents that
the toxicity stage rejects go, one document of each near-duplicate group stays, repeated passages
are cut out of the texts, personal data is replaced by pseudonyms, and the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import jaccard, packing, pii, suffix_dedup, toxicity
from stratalens.llm.common import lean, materialise, read_table, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of this score or more are rejected.
TOXIC = 0.5


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the lexicon from labelled rows of the input and keeps what scores below TOXIC."""
    lexicon = toxicity.learn(*toxicity.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return _columns(toxicity.score(_columns(docs), lexicon).filter(F.col("score") < TOXIC))


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns with ``row_key``, the hash of id and text that the operators know a row by."""
    return _columns(docs).withColumn("row_key", F.xxhash64(F.col("doc_id").cast("long"), "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles the one
    with the smallest id stays (one without an id only where none has one); of rows of one id with
    equal texts, one. Wordless ones all stay."""
    small_batches(spark)
    found = jaccard.join(docs, words=5, percent=80)
    stay = found.filter("first").select("row_key").distinct()
    kept = _keyed(docs).join(stay.hint("shuffle_merge"), "row_key", "left_semi")
    return kept.dropDuplicates(["row_key", "doc_id"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes of strings of 400 bytes that also start elsewhere, and passages of 50 words or more that also
    stand elsewhere, however many bytes they have and whatever white space parts them; a sign that is cut through
    goes entirely. ``n_chars`` is counted anew; documents stay, with null texts unchanged."""
    small_batches(spark)
    keyed = suffix_dedup.keyed(_columns(docs).withColumn("own_id", F.col("doc_id")))
    rows = keyed.filter(F.octet_length("text") >= suffix_dedup.LEAST).select("doc_id", "text", "row_key")
    spans = materialise(suffix_dedup.repeated_intervals(rows, words=True), "pipeline-intervals")
    joined = suffix_dedup.with_side(keyed, spans, "left").select(F.col("own_id").alias("doc_id"), *COLUMNS[1:], "intervals", "passages")

    def cut(batches):
        import pyarrow as pa

        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            texts = []
            for text, found, marked in zip(*(batch.column(i).to_pylist() for i in (1, 5, 6)), strict=True):
                if text and (found or marked):
                    raw = text.encode()
                    ends = lambda spans: [(s["start"], s["end"]) for s in spans or ()]
                    spans = suffix_dedup.merged(ends(found) + (suffix_dedup.words_cut(raw, ends(marked)) if marked else []))
                    text = suffix_dedup.without(raw, spans).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *[batch.column(i) for i in (2, 3, 4)]], names=COLUMNS)

    out = joined.mapInArrow(lean(cut), docs.select(*COLUMNS).schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format; lengths do not change much."""
    return _columns(pii.pseudonymise(_columns(docs)).withColumn("n_chars", F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, linked components and a linear program are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
