"""Registered queries of the subpackage, and SQL for those that SQL can express."""

from pyspark.sql import functions as F

from retentia.llm import (
    centroids, covertree, hamming, jaccard, langid, lattice, licenses, mixing, passages, pieces, ranked, sharding, warc,
)
from retentia.llm.common import table
from retentia.sources.staging import new_folder, stage

PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_path():
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_cover_tree_neardup(spark, sf):
    return covertree.near_duplicates(table(spark, sf, "embeddings"))


def op2_piece_roundtrip(spark, sf):
    coded = pieces.encode_decode(table(spark, sf, "documents").select("doc_id", "text"), piece_model_path())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_lattice_scores(spark, sf):
    docs = table(spark, sf, "documents")
    return lattice.score_texts(
        docs, piece_model_path(), ~langid.held_out("doc_id", folds=5)
    )


def op4_license_scan(spark, sf):
    found = licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return found.drop("text")


def op5_hamming_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    widths = hamming.segment_widths(hamming.code_length(vectors), vectors.count())
    codes = stage(hamming.sign_codes(vectors, widths), "sign-codes")
    found = hamming.top_k(codes, codes.where("id % 50 = 0"), widths)
    return found.withColumnRenamed("id", "vec_id")


def op6_language(spark, sf):
    docs = table(spark, sf, "documents")
    content = langid.dictionaries(docs.where(~langid.held_out("doc_id")))
    found = langid.identify(docs.select("doc_id", "text"), content)
    return found.select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_jaccard_join(spark, sf):
    return jaccard.jaccard_components(table(spark, sf, "documents"))


def op8_hilbert_shards(spark, sf):
    placed = sharding.hilbert_shards(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op9_systematic_mix(spark, sf):
    return mixing.sample_copies(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op10_warc_roundtrip(spark, sf):
    pages = table(spark, sf, "pages")
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.record_plan(pages), warc.train_dictionary(pages), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op11_centroid_clusters(spark, sf):
    return centroids.digest(centroids.cluster(table(spark, sf, "embeddings")))


def op12_passage_dedup(spark, sf):
    found = passages.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_documents(spark, sf):
    return ranked.top_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES = {
    f.__name__: f for f in (
        op1_cover_tree_neardup, op2_piece_roundtrip, op3_lattice_scores, op4_license_scan,
        op5_hamming_topk, op6_language, op7_jaccard_join, op8_hilbert_shards, op9_systematic_mix,
        op10_warc_roundtrip, op11_centroid_clusters, op12_passage_dedup, op13_ranked_documents,
    )
}

SQL = {
    "op4_license_scan": licenses.oracle_sql(),
    "op5_hamming_topk": hamming.oracle_sql(),
    "op11_centroid_clusters": centroids.oracle_sql(),
    "op12_passage_dedup": passages.oracle_sql(),
    "op13_ranked_documents": ranked.oracle_sql(),
}
