"""The named queries over annotated tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import is_alpha, is_punct, is_stop, morph_has
from . import kernels, structure
from .tokenizer import span_text

C = F.col


def pos_freq(t: DataFrame) -> DataFrame:
    return t.groupBy("doc_id", F.coalesce("pos", F.lit("")).alias("pos")).agg(F.count("*").alias("n"))


def proper_nouns(t: DataFrame) -> DataFrame:
    return t.filter("pos = 'PROPN'").select("doc_id", "i", "text")


def comparatives(t: DataFrame) -> DataFrame:
    return t.filter(C("tag").isin("JJR", "JJS", "RBR", "RBS")).select("doc_id", "i", "text", "tag")


def unique_lemmas(t: DataFrame) -> DataFrame:
    return t.select("doc_id", "lemma").distinct()


def _content(t: DataFrame) -> DataFrame:
    return t.filter(~is_stop(C("text")) & ~is_punct(C("text")))


def content_words(t: DataFrame) -> DataFrame:
    return _content(t).select("doc_id", "i", "lemma")


def lemma_freq(t: DataFrame) -> DataFrame:
    return _content(t).groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


def sentence_roots(t: DataFrame) -> DataFrame:
    return t.filter("dep = 'ROOT'").select("doc_id", "i", "text", "dep", "pos")


def svo(t: DataFrame) -> DataFrame:
    """Verbs with their first subject and first object; one aggregate over children by head, then the verb."""
    kids = t.filter(C("dep").isin("nsubj", "dobj") & (C("head") != C("i"))).groupBy("doc_id", C("head").alias("i")).agg(
        *[F.min_by(F.when(C("dep") == d, C("text")), F.when(C("dep") == d, C("i"))).alias(n) for d, n in (("nsubj", "subj"), ("dobj", "obj"))])
    return t.filter("pos = 'VERB'").select("doc_id", "i", C("text").alias("verb")).join(kids, ["doc_id", "i"]).filter("subj is not null and obj is not null").select("doc_id", "i", "subj", "verb", "obj")


def _with_head(t: DataFrame, dep: str) -> DataFrame:
    h = t.select("doc_id", C("i").alias("head"), C("text").alias("head_text"), C("pos").alias("head_pos"))
    return t.filter(C("dep") == dep).select("doc_id", "i", "text", "head").join(h, ["doc_id", "head"])


def passive_subjects(t: DataFrame) -> DataFrame:
    return _with_head(t, "nsubjpass").select("doc_id", "i", "text", C("head_text").alias("head"))


def negations(t: DataFrame) -> DataFrame:
    return _with_head(t, "neg").select("doc_id", "i", C("text").alias("neg"), C("head_text").alias("head"), "head_pos")


def sentence_texts(t: DataFrame) -> DataFrame:
    """By window and aggregate alone: each sentence's tokens are joined in order, the last blank left out."""
    s = structure.with_sentence(t)
    last = Window.partitionBy("doc_id", "sent")
    piece = F.struct("i", "text", F.when(C("i") == F.max("i").over(last), "").otherwise(C("ws")).alias("ws"))
    return s.select("doc_id", "sent", "i", piece.alias("p")).groupBy("doc_id", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: F.concat(x["text"], x["ws"])), "").alias("text"))


def sentence_count(t: DataFrame) -> DataFrame:
    return structure.with_sentence(t).groupBy("doc_id").agg((F.max("sent") + 1).cast("long").alias("n"))


def plural_nouns(t: DataFrame) -> DataFrame:
    return t.filter((C("pos") == "NOUN") & morph_has(C("morph"), "Number=Plur")).select("doc_id", "i", "text")


def past_verbs(t: DataFrame) -> DataFrame:
    return t.filter((C("pos") == "VERB") & morph_has(C("morph"), "Tense=Past")).select("doc_id", "i", "text")


def noun_chunk_texts(t: DataFrame) -> DataFrame:
    return span_text(t, structure.noun_chunks(t))


def questions(t: DataFrame) -> DataFrame:
    """Whether a sentence begins with a wh-tag or ends in a question mark."""
    s = structure.with_sentence(t).groupBy("doc_id", "sent").agg(F.min_by("tag", "i").alias("a"), F.max_by("text", "i").alias("z"))
    return s.select("doc_id", "sent", (C("a").startswith("W") | (C("z") == "?")).alias("is_question"))


def keywords(t: DataFrame) -> DataFrame:
    return t.filter(C("pos").isin("NOUN", "PROPN") & ~is_stop(C("text"))).groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


def entity_texts(t: DataFrame) -> DataFrame:
    return span_text(t, structure.entities(t), "label")


def token_report(t: DataFrame, first: int = 10) -> DataFrame:
    return t.filter(C("i") < first).select("doc_id", "i", "text", "lemma", "pos", "tag", is_alpha(C("text")).alias("is_alpha"), is_stop(C("text")).alias("is_stop"))


def dep_report(t: DataFrame, first: int = 10) -> DataFrame:
    h = t.select("doc_id", C("i").alias("head"), C("text").alias("head_text"))
    return t.filter(C("i") < first).select("doc_id", "i", "text", "dep", "head").join(h, ["doc_id", "head"]).select("doc_id", "i", "text", "dep", "head_text")


def document_vectors(t: DataFrame, vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(doc_id, v): mean of the vectors (key, v, of width numbers) of the lower-cased tokens that have one. A document's words are counted before they meet vectors."""
    width = width or max(0, vectors.select(F.max(F.size("v"))).first()[0] or 0)
    each = t.groupBy("doc_id", C("lower").alias("key")).agg(F.count("*").alias("n")).join(vectors, "key")
    sums = each.groupBy("doc_id").agg(F.sum("n").alias("n"), *[F.sum(C("n") * C("v")[k].cast("double")).alias(f"x{k}") for k in range(width)])
    return sums.select("doc_id", F.array(*[C(f"x{k}") / C("n") for k in range(width)]).alias("v"))


def similarity(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) with the cosine of their documents' vectors; 0 where one has none."""
    a, b = docs.select(C("doc_id").alias("a"), C("v").alias("va")), docs.select(C("doc_id").alias("b"), C("v").alias("vb"))
    p = pairs.join(a, "a", "left").join(b, "b", "left")
    return p.select("a", "b", F.coalesce(kernels.cosine(C("va"), C("vb")), F.lit(0.0)).alias("similarity"))


WORKFLOWS = {
    "w01_pos_freq": pos_freq, "w02_propn": proper_nouns, "w03_comparatives": comparatives, "w04_unique_lemmas": unique_lemmas, "w05_content_words": content_words,
    "w06_lemma_freq": lemma_freq, "w07_sent_roots": sentence_roots, "w08_svo": svo, "w09_passive": passive_subjects, "w10_negation": negations, "w11_sent_segmentation": sentence_texts,
    "w12_sent_count": sentence_count, "w13_plural_nouns": plural_nouns, "w14_past_tense": past_verbs, "w15_noun_chunks": noun_chunk_texts, "w16_questions": questions, "w17_keywords": keywords,
    "w18_entities": entity_texts, "w19_token_report": token_report, "w20_dep_report": dep_report}
