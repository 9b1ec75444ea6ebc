"""Language models as plug-ins, with deterministic lexicon and rule defaults.

A model is registered under a name as a factory; the factory runs once per Python worker and gives a function from a list
of texts to a list of results. The default recogniser is a lexicon: a table of surfaces, found as whole words in any case
with their offsets, wholly inside the JVM.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import _literal, keyword_relation, matches

Factory = Callable[[], Callable[[list[str]], list]]
_REGISTRY: dict[str, Factory] = {}
_KEYS: dict[str, str] = {}

# A small lexicon of drugs and problems with the models that would find them.
LEXICON = [
    ("lisinopril", "DRUG", "Med7", 1.0), ("aspirin", "DRUG", "Med7", 1.0), ("heparin", "DRUG", "Med7", 1.0),
    ("pneumonia", "problem", "ClinicalBERT", 0.9), ("sepsis", "problem", "ClinicalBERT", 0.9), ("congestive heart failure", "problem", "ClinicalBERT", 0.9),
    ("hypertension", "problem", "ClinicalBERT", 0.85), ("infection", "problem", "ClinicalBERT", 0.8), ("fracture", "problem", "ClinicalBERT", 0.8), ("mass", "problem", "ClinicalBERT", 0.7),
]
# What a zero-shot classifier is asked of a drug and a disease, and of a context.
RELATION_HYPOTHESES = {
    "TREATS": "is a medication used specifically to treat",
    "CAUSES": "is a direct side effect or complication caused by",
    "UNRELATED": "is completely unrelated and mentioned in a different context",
}
RELATION_SENTENCE = "The medication {drug} {template} the condition {disease}."
EVIDENCE_HYPOTHESES = {
    "exact synonym": "The sentence expresses an exact synonym relationship between the clinical terms.",
    "clinical abbreviation": "The sentence links a clinical abbreviation to its expanded meaning.",
    "direct implication": "The sentence directly implies this clinical relationship.",
    "hyponym/subtype": "The sentence indicates one term is a subtype or specific kind of the other.",
}
# The evidence without a model, tags of words that are no entities, labels of the older recogniser, and the
# longest window of the radiology model.
DEFAULT_EVIDENCE, DEFAULT_EVIDENCE_SCORE = "direct implication", 0.55
NOISE_TAGS = ["CCONJ", "ADP", "VERB", "AUX"]
LEGACY_LABELS = ["CHEMICAL", "DISEASE"]
WINDOW = 510
_ENTITIES = "note_id string, hadm_id bigint, sentence_index bigint, entity_group string, word string, start bigint, end_ bigint, score double, source_model string"


def register(name: str, factory: Factory) -> None:
    _REGISTRY[name], _KEYS[name] = factory, f"{name}-{uuid.uuid4().hex}"


def available(name: str, module: str | None = None) -> bool:
    """Whether a model is registered and its library can be imported."""
    return name in _REGISTRY and (module is None or find_spec(module) is not None)


class Held:
    """A model that is made on first use in a Python worker and kept for all later batches, tasks and queries of that worker,
    until another factory is registered under its name."""

    made: dict[str, Callable] = {}

    def __init__(self, name: str):
        self.factory, self.key = _REGISTRY[name], _KEYS[name]

    def __call__(self, *args):
        if self.key not in Held.made:
            Held.made[self.key] = self.factory()
        return Held.made[self.key](*args)


def _entity(label: str, source: str, scores: Column) -> Callable[[Column], Column]:
    return lambda m: F.struct(
        F.lit(label).alias("entity_group"), m["full"].alias("word"), m["start"].cast("bigint").alias("start"), m["end_"].cast("bigint").alias("end_"), scores[F.lower(m["full"])].alias("score"), F.lit(source).alias("source_model")
    )


def lexicon_entities(sentences: DataFrame, lexicon: list[tuple[str, str, str, float]] = LEXICON) -> DataFrame:
    """Entities of ``sentences`` (note_id, hadm_id, sentence_index, sentence_text): one pass over the table, one alternation
    per label and source, so the number of passes over a text does not follow the number of surfaces."""
    found = []
    for label, source in sorted({(label, source) for _, label, source, _ in lexicon}):
        own = [(s, score) for s, lb, so, score in lexicon if (lb, so) == (label, source)]
        pattern = r"(?iU)\b(?:" + "|".join(_literal(s) for s, _ in sorted(own, key=lambda x: -len(x[0]))) + r")\b"
        scores = F.create_map(*[x for s, score in own for x in (F.lit(s), F.lit(float(score)))])
        found.append(F.coalesce(F.transform(matches(F.col("sentence_text"), pattern, 0), _entity(label, source, scores)), F.array()))
    rows = sentences.where(F.col("sentence_text").isNotNull()).select("note_id", "hadm_id", F.col("sentence_index").cast("bigint").alias("sentence_index"), F.explode(F.concat(*found)).alias("m"))
    return rows.select("note_id", "hadm_id", "sentence_index", "m.*")


def _missing(df: DataFrame, model: str) -> DataFrame:
    warnings.warn(f"model {model} is not registered; it finds no entities", stacklevel=3)
    return df.sparkSession.createDataFrame([], _ENTITIES)


def model_entities(sentences: DataFrame, model: str, source: str, labels: list[str] | None = None, window: int | None = None) -> DataFrame:
    """Entities by a registered model (list of texts to lists of (group, word, start, end, score)); no entities, with a
    warning on the driver, if the model is not there. ``labels``: the only ones that are kept; ``window``: words of a text
    that the model reads, as the models with a fixed window do (the rest of a longer text is another call's business)."""
    if model not in _REGISTRY:
        return _missing(sentences, model)
    predict = Held(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("note_id", pa.string()), ("hadm_id", pa.int64()), ("sentence_index", pa.int64()), ("entity_group", pa.string()), ("word", pa.string()), ("start", pa.int64()), ("end_", pa.int64()), ("score", pa.float64()), ("source_model", pa.string())]
        for b in batches:
            notes, adms, idx, texts = (b.column(k).to_pylist() for k in range(4))
            texts = [windowed(t or "", window) for t in texts]
            rows = [
                {"note_id": n, "hadm_id": a, "sentence_index": i, "entity_group": g, "word": w, "start": s, "end_": e, "score": float(p), "source_model": source}
                for n, a, i, found in zip(notes, adms, idx, predict(texts))
                for g, w, s, e, p in found
                if labels is None or g in labels
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    return sentences.select("note_id", "hadm_id", F.col("sentence_index").cast("bigint"), "sentence_text").mapInArrow(run, _ENTITIES)


def windowed(text: str, words: int | None) -> str:
    """The first ``words`` words of a text, as it is written; all of it without a limit."""
    if words is None:
        return text
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    return text if len(ends) <= words else text[: ends[words - 1]]


def recognise(sentences: DataFrame, recognisers: list[tuple[str, str]] | None = None, lexicon: list[tuple[str, str, str, float]] = LEXICON) -> DataFrame:
    """The union of several recognisers: the lexicon, and each registered (model, source); columns that one of them lacks
    come out null."""
    out = lexicon_entities(sentences, lexicon)
    for model, source in recognisers or []:
        out = out.unionByName(model_entities(sentences, model, source), allowMissingColumns=True)
    return out


def _classified(model: str, kind: str, default: tuple[str, float]):
    """An Arrow function from texts to (label, score) by a registered model."""
    predict = Held(model)

    @F.arrow_udf(f"struct<{kind}:string,score:double>")
    def classify(*cols: pa.Array) -> pa.Array:
        args = [c.to_pylist() for c in cols]
        found = predict([tuple(x or "" for x in row) if len(cols) > 1 else row[0] or "" for row in zip(*args)])
        rows = [{kind: default[0] if lb is None else lb, "score": default[1] if lb is None else float(s)} for lb, s in found]
        return pa.array(rows, pa.struct([(kind, pa.string()), ("score", pa.float64())]))

    return classify


def relation_classifier(model: str | None = None) -> Callable[[Column, Column, Column], tuple[Column, Column]]:
    """(context, drug, disease) to (relation, score): keywords of the context by default, or a registered model, a function
    from a list of (context, drug, disease) to a list of (label, score). ``hypotheses`` gives the sentences to be compared."""
    if model is None or model not in _REGISTRY:
        return lambda context, drug=None, disease=None: keyword_relation(context)
    classify = _classified(model, "label", ("UNRELATED", 0.0))

    def run(context: Column, drug: Column | None = None, disease: Column | None = None) -> tuple[Column, Column]:
        none = F.lit(None).cast("string")
        got = classify(context, none if drug is None else drug, none if disease is None else disease)
        return got["label"], got["score"]

    return run


def evidence_classifier(model: str | None = None) -> Callable[[Column], tuple[Column, Column]]:
    """Context to (kind of evidence, score): the fixed default, or a registered model (list of contexts to (kind, score))."""
    if model is None or model not in _REGISTRY:
        return lambda context: (F.lit(DEFAULT_EVIDENCE), F.lit(DEFAULT_EVIDENCE_SCORE))
    classify = _classified(model, "kind", (DEFAULT_EVIDENCE, DEFAULT_EVIDENCE_SCORE))

    def run(context: Column) -> tuple[Column, Column]:
        got = classify(context)
        return got["kind"], got["score"]

    return run


def hypotheses(drug: str, disease: str) -> dict[str, str]:
    """The sentence of each relation for a drug and a disease."""
    return {label: RELATION_SENTENCE.format(drug=drug, template=t, disease=disease) for label, t in RELATION_HYPOTHESES.items()}


def word_tags(words: DataFrame, model: str | None = None) -> DataFrame:
    """``word, tag, is_stop`` of the different words (in lower case, without blanks) by a registered tagger (list of words to
    (tag, stop word or not)); an empty table without one, so that nothing more is filtered."""
    schema = "word string, tag string, is_stop boolean"
    if model is None or model not in _REGISTRY:
        return words.sparkSession.createDataFrame([], schema)
    predict = Held(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(0).to_pylist()
            found = predict(given)
            yield pa.RecordBatch.from_arrays([pa.array(given, pa.string()), pa.array([t for t, _ in found], pa.string()), pa.array([bool(x) for _, x in found])], names=["word", "tag", "is_stop"])

    one = words.select(F.lower(F.trim("word")).alias("word")).where(F.col("word").isNotNull() & ~F.col("word").contains(" ")).distinct()
    return one.mapInArrow(run, schema)


def sentence_splitter(model: str | None = None) -> Callable[[Column], Column] | None:
    """Text to array of its pieces by a registered splitter (list of texts to lists of pieces); None without one, for the
    built-in rule."""
    if model is None or model not in _REGISTRY:
        return None
    predict = Held(model)

    @F.arrow_udf("array<string>")
    def split(col: pa.Array) -> pa.Array:
        return pa.array(predict([t or "" for t in col.to_pylist()]), pa.list_(pa.string()))

    return split


def linked_or_unmapped(candidates: DataFrame, least: float = 0.65) -> DataFrame:
    """text, cui, canonical_name: the first candidate of a text if its score reaches ``least``, else UNMAPPED."""
    best = candidates.groupBy("text").agg(F.max_by(F.struct("cui", "canonical_name"), F.struct("score", "cui")).alias("b"), F.max("score").alias("score"))
    ok = F.col("score") >= least
    return best.select("text", F.when(ok, F.col("b.cui")).otherwise("UNMAPPED").alias("cui"), F.when(ok, F.col("b.canonical_name")).otherwise("UNMAPPED").alias("canonical_name"))
