"""Which rows of labelled corpora are toxic, their text and score, by the kind of corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modwarden.functions import hashing, signals
from modwarden.sources import scans

#: Columns of the kinds of corpora, and the scores that labels stand for.
SCORES = {
    "jigsaw": ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"],
    "real_toxicity": ["toxicity", "profanity", "severe_toxicity", "prompt_toxicity", "continuation_toxicity", "prompt.toxicity", "prompt.profanity", "prompt.severe_toxicity", "continuation.toxicity", "continuation.profanity", "continuation.severe_toxicity"],
    "civil_comments": ["toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack"],
    "berkeley_hate_score": ["hate_speech_score", "hatespeech", "insult", "humiliate", "dehumanize", "violence", "genocide"],
}
#: Scores that say whether a row is toxic, where not all of SCORES do.
DECIDING = {"jigsaw": ["toxic", "severe_toxic", "obscene", "insult", "identity_hate"]}
REAL_TOXICITY, JIGSAW, LABELLED, FIRST_CLASS, PAIRED = 0.8, 0.5, 0.95, 1.0, 0.98
_COMMENT, _POST, _TWEET = ["comment_text", "text", "comment", "content"], ["text", "tweet", "comment", "content"], ["tweet", "text", "comment", "content"]
TEXTS = {
    "jigsaw": _COMMENT,
    "real_toxicity": ["prompt.text", "continuation.text", "text", "comment_text", "comment", "content"],
    "civil_comments": ["text", "comment_text", "comment", "content"],
    "berkeley_hate_score": ["text", "comment_text", "comment", "content"],
    "tdavidson": _TWEET,
    "binary_label_tweets": _TWEET,
    "tdavidson_setfit": _POST,
    "binary_label_setfit": _POST,
    "tweet_eval_binary": _POST,
    "paradetox_pairs": ["en_toxic_comment", "toxic_comment", "toxic", "text"],
}


@dataclass(frozen=True)
class Spec:
    """A public corpus: its id, kind and configuration, and its splits in the order they are tried."""

    source: str
    kind: str
    splits: tuple[str, ...] = ("train",)
    config: str = ""

    @property
    def folder(self) -> str:
        return "/".join(filter(None, (self.source.replace("/", "__"), self.config)))


#: Ids, kinds and splits of public corpora, in the order in which their rows count.
SPECS = (
    Spec("julien-c/jigsaw-toxic-comment-classification-challenge", "jigsaw"),
    Spec("thesofakillers/jigsaw-toxic-comment-classification-challenge", "jigsaw"),
    Spec("tcapelle/jigsaw-toxic-comment-classification-challenge", "jigsaw"),
    Spec("Mirenda/jigsaw-toxic-comment-classification-challenge", "jigsaw"),
    Spec("allenai/real-toxicity-prompts", "real_toxicity"),
    Spec("Ahren09/RealToxicityPrompts", "real_toxicity", ("train", "validation", "test")),
    Spec("google/civil_comments", "civil_comments"),
    Spec("tdavidson/hate_speech_offensive", "tdavidson"),
    Spec("SetFit/hate_speech_offensive", "tdavidson_setfit", ("train", "test")),
    Spec("SetFit/hate_speech18", "binary_label_setfit", ("train", "test")),
    Spec("tweets-hate-speech-detection/tweets_hate_speech_detection", "binary_label_tweets"),
    Spec("ucberkeley-dlab/measuring-hate-speech", "berkeley_hate_score"),
    Spec("tweet_eval", "tweet_eval_binary", config="hate"),
    Spec("tweet_eval", "tweet_eval_binary", config="offensive"),
    Spec("s-nlp/paradetox", "paradetox_pairs"),
)


def toxic_texts(spark: SparkSession, root: str, specs: tuple[Spec, ...] = SPECS, least: float = 0.5, kind: str = "json") -> DataFrame:
    """rank (of the corpus), source, text and score of the toxic rows of all corpora that lie under root/folder/split.

    Of each the first split that is there counts; a corpus without any is left out."""
    found = [spark.createDataFrame([], "rank int, source string, text string, score double")]
    for rank, spec in enumerate(specs):
        rows = scans.first_split(spark, f"{root}/{spec.folder}", list(spec.splits), kind)
        if rows is not None:
            found.append(toxic(rows, spec.kind, least).select(F.lit(rank).alias("rank"), F.lit(spec.source).alias("source"), "text", "score"))
    return scans.corpora(*found)


def _most(rows: DataFrame, names: list[str]) -> Column:
    """The greatest of the scores a table has, 0 at least."""
    have = [hashing.to_float(c.cast("string")) for c in scans.fields(rows, names)]
    return F.greatest(F.lit(0.0), F.lit(0.0), *have)


def _label(rows: DataFrame, *names: str) -> Column:
    return F.coalesce(*[hashing.to_int(c.cast("string")) for c in scans.fields(rows, list(names))], F.lit(None).cast("int"))


def toxic(rows: DataFrame, kind: str, least: float = 0.5) -> DataFrame:
    """text and score of the toxic rows of a corpus of a kind; a row without text keeps ''  (a pair without one goes).

    `least` is the score that rows of scored comments must reach."""
    text = scans.text_value(rows, TEXTS[kind])
    if kind in SCORES:
        score = _most(rows, SCORES[kind])
        bar = {"jigsaw": JIGSAW, "real_toxicity": REAL_TOXICITY}.get(kind, least)
        ok = _most(rows, DECIDING.get(kind, SCORES[kind])) >= bar
    elif kind == "tdavidson":  # 0 hateful, 1 offensive, 2 neither
        label = _label(rows, "class", "label")
        ok, score = label != 2, F.when(label == 0, F.lit(FIRST_CLASS)).otherwise(F.lit(LABELLED))
    elif kind in ("tdavidson_setfit", "binary_label_setfit"):
        label = _label(rows, "label")
        said = [signals.label_state(c.cast("string")) for c in scans.fields(rows, ["label_text"])]
        ok, score = F.coalesce(*said, label.isin(0, 1) if kind == "tdavidson_setfit" else label == 1), F.lit(LABELLED)
    elif kind in ("binary_label_tweets", "tweet_eval_binary"):
        label = _label(rows, "label")
        ok, score = (label != 0) if kind == "binary_label_tweets" else (label == 1), F.lit(LABELLED)
    else:
        ok, score = text != "", F.lit(PAIRED)
    return rows.where(ok).select(text.alias("text"), score.alias("score"))
