"""Part-of-speech tag sets, their ids, and the way from two of them to a third."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.schema import PAD, UNK

# Tags by standard and category, in the order of their ids, which begin at 2.
TAGS = {
    "UPOS": {
        "POS": ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"],
        "GENDER": ["Gender=Masc", "Gender=Fem", "Gender=Neut"],
        "NUMBER": ["Number=Sing", "Number=Plur"],
        "CASE": ["Case=Nom", "Case=Gen", "Case=Dat", "Case=Acc", "Case=Ins", "Case=Loc", "Case=Voc"],
    },
    "RUCORPORA": {
        "POS": [
            "S", "A", "NUM", "ANUM", "V", "ADV", "PRAEDIC", "PARENTH", "SPRO", "APRO", "ADVPRO", "PRAEDICPRO", "PR", "CONJ", "PART", "INTJ",
            "INIT", "NONLEX",
        ],
        "GENDER": ["m", "f", "m-f", "n"],
        "NUMBER": ["sg", "pl"],
        "CASE": ["nom", "gen", "dat", "acc", "ins", "loc", "gen2", "acc2", "loc2", "voc", "adnum"],
    },
    "OPENCORPORA": {
        "POS": [
            "NOUN", "ADJF", "ADJS", "COMP", "VERB", "INFN", "PRTF", "PRTS", "GRND", "NUMR", "ADVB", "NPRO", "PRED", "PREP", "CONJ", "PRCL",
            "INTJ",
        ],
        "GENDER": ["masc", "femn", "neut", "ms-f"],
        "NUMBER": ["sing", "plur"],
        "CASE": ["nomn", "gent", "datv", "accs", "ablt", "loct", "voct", "gen2", "acc2", "loc2"],
    },
}
# What each tag of the other two standards is in UPOS.
TO_UPOS = {
    "RUCORPORA": {
        "POS": {
            "S": "NOUN", "A": "ADJ", "NUM": "NUM", "ANUM": "ADJ", "V": "VERB", "ADV": "ADV", "PRAEDIC": "ADV", "PARENTH": "ADV",
            "SPRO": "PRON", "APRO": "DET", "ADVPRO": "ADV", "PRAEDICPRO": "PRON", "PR": "ADP", "CONJ": "CCONJ", "PART": "PART",
            "INTJ": "INTJ", "INIT": "PROPN", "NONLEX": "X",
        },
        "GENDER": {"m": "Gender=Masc", "f": "Gender=Fem", "n": "Gender=Neut", "m-f": "Gender=Masc"},
        "NUMBER": {"sg": "Number=Sing", "pl": "Number=Plur"},
        "CASE": {
            "nom": "Case=Nom", "gen": "Case=Gen", "gen2": "Case=Gen", "dat": "Case=Dat", "acc": "Case=Acc", "acc2": "Case=Acc",
            "ins": "Case=Ins", "loc": "Case=Loc", "loc2": "Case=Loc", "voc": "Case=Voc", "adnum": "Case=Gen",
        },
    },
    "OPENCORPORA": {
        "POS": {
            "NOUN": "NOUN", "ADJF": "ADJ", "ADJS": "ADJ", "COMP": "ADJ", "PRTF": "ADJ", "PRTS": "ADJ", "VERB": "VERB", "INFN": "VERB",
            "GRND": "VERB", "NUMR": "NUM", "ADVB": "ADV", "NPRO": "PRON", "PRED": "ADV", "PREP": "ADP", "CONJ": "CCONJ", "PRCL": "PART",
            "INTJ": "INTJ",
        },
        "GENDER": {"masc": "Gender=Masc", "femn": "Gender=Fem", "neut": "Gender=Neut", "ms-f": "Gender=Masc"},
        "NUMBER": {"sing": "Number=Sing", "plur": "Number=Plur"},
        "CASE": {
            "nomn": "Case=Nom", "gent": "Case=Gen", "gen2": "Case=Gen", "datv": "Case=Dat", "accs": "Case=Acc", "acc2": "Case=Acc",
            "ablt": "Case=Ins", "loct": "Case=Loc", "loc2": "Case=Loc", "voct": "Case=Voc",
        },
    },
}


def tag_rows() -> list[tuple[str, str, str, int]]:
    """(standard, category, tag, id), padding 0 and unknown 1 included."""
    return [(s, c, t, i) for s, cs in TAGS.items() for c, tags in cs.items() for i, t in enumerate([PAD, UNK, *tags])]


def crosswalk_rows() -> list[tuple[str, str, str, str]]:
    """(source standard, category, tag, UPOS tag)."""
    return [(s, c, *pair) for s, cs in TO_UPOS.items() for c, pairs in cs.items() for pair in pairs.items()]


def tagset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tag_rows(), "standard string, category string, tag string, id int")


def crosswalk(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(crosswalk_rows(), "src_standard string, category string, src_tag string, upos_tag string")


def with_tag_id(df: DataFrame, standard: str = "standard", category: str = "category", tag: str = "tag") -> DataFrame:
    """df with tag_id; tags the standard lacks get the id of <UNK>, null tags null. The 150 rows are broadcast."""
    t = tagset(df.sparkSession).select(F.col("standard").alias("__s"), F.col("category").alias("__c"), F.col("tag").alias("__t"), F.col("id").alias("tag_id"))
    joined = df.drop("tag_id").join(F.broadcast(t), (F.col(standard) == F.col("__s")) & (F.col(category) == F.col("__c")) & (F.col(tag) == F.col("__t")), "left")
    return joined.withColumn("tag_id", F.when(F.col(tag).isNotNull(), F.coalesce("tag_id", F.lit(1)))).drop("__s", "__c", "__t")


def with_upos(df: DataFrame, standard: str = "standard", category: str = "category", tag: str = "tag") -> DataFrame:
    """df with upos_tag, null for a tag without one."""
    t = crosswalk(df.sparkSession).select(F.col("src_standard").alias("__s"), F.col("category").alias("__c"), F.col("src_tag").alias("__t"), "upos_tag")
    return df.drop("upos_tag").join(F.broadcast(t), (F.col(standard) == F.col("__s")) & (F.col(category) == F.col("__c")) & (F.col(tag) == F.col("__t")), "left").drop("__s", "__c", "__t")
