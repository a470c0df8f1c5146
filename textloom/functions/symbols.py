"""Symbols: names with small numbers of their own, which a string store does not hash.

The empty string is 0; the names are numbered from 1 in the order below. Note
that ``root`` is a symbol while ``ROOT``, the label of sentence roots, is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The names in the order of their numbers. FLAG and DEPRECATED names follow a rule.
_FLAGS = "IS_ALPHA IS_ASCII IS_DIGIT IS_LOWER IS_PUNCT IS_SPACE IS_TITLE IS_UPPER LIKE_URL LIKE_NUM LIKE_EMAIL IS_STOP IS_OOV_DEPRECATED IS_BRACKET IS_QUOTE IS_LEFT_PUNCT IS_RIGHT_PUNCT IS_CURRENCY"
_ATTRIBUTES = "ID ORTH LOWER NORM SHAPE PREFIX SUFFIX LENGTH CLUSTER LEMMA POS TAG DEP ENT_IOB ENT_TYPE HEAD SENT_START SPACY PROB LANG"
_PARTS_OF_SPEECH = "ADJ ADP ADV AUX CONJ CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X EOL SPACE"
_ENTITIES = "PERSON NORP FACILITY ORG GPE LOC PRODUCT EVENT WORK_OF_ART LANGUAGE LAW DATE TIME PERCENT MONEY QUANTITY ORDINAL CARDINAL"
_DEPENDENCIES = (
    "acomp advcl advmod agent amod appos attr aux auxpass cc ccomp complm conj cop csubj csubjpass dep det dobj expl hmod hyph infmod intj iobj mark meta neg nmod nn npadvmod nsubj "
    "nsubjpass num number oprd obj obl parataxis partmod pcomp pobj poss possessive preconj prep prt punct quantmod relcl rcmod root xcomp acl")
_LATER = "ENT_KB_ID MORPH ENT_ID IDX _"

_ALL = [
    *_FLAGS.split(), *(f"FLAG{k}" for k in range(19, 64)), *_ATTRIBUTES.split(), *_PARTS_OF_SPEECH.split(), *(f"DEPRECATED{k:03d}" for k in range(1, 277)),
    *_ENTITIES.split(), *_DEPENDENCIES.split(), *_LATER.split()]
SYMBOLS: dict[str, int] = {name: n for n, name in enumerate(_ALL, 1)}
NAMES: dict[int, str] = {n: name for name, n in SYMBOLS.items()}


def symbol_id(name: str) -> int | None:
    return 0 if name == "" else SYMBOLS.get(name)


def symbol_name(number: int) -> str | None:
    return "" if number == 0 else NAMES.get(number)


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SYMBOLS.items()), "name string, id int")
