"""What models and parsers must offer, and deterministic stand-ins for them.

A provider is created on a worker, by a factory that is sent there, and used for all rows of a partition; so a client or a model is
loaded once a task and never travels.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Scores that the stand-in judge gives.
STAND_IN_SCORES = {"seniority_title": 85, "technical_skills": 90, "work_experience": 82, "education_certifications": 88, "hidden_culture": 80}
STAND_IN_OTHER = 75


class Generator(Protocol):
    """A language model: prompt to answer."""

    def generate(self, prompt: str, **context: object) -> str: ...


class Parser(Protocol):
    """A reader of binary files: bytes to text and warnings."""

    def parse(self, name: str, content: bytes) -> tuple[str, list[str]]: ...


class Embedder(Protocol):
    """Texts to vectors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class StandInJudge:
    """Answers with a fixed score for each category."""

    def generate(self, prompt: str, **context: object) -> str:
        score = STAND_IN_SCORES.get(str(context.get("category")), STAND_IN_OTHER)
        return json.dumps(
            {"evidence_quotes": ["quoted"], "strengths": ["fits the role"], "gaps": ["to be checked"], "reasoning_summary": "stand-in", "score": score}
        )


# The document that the stand-in extractor reads out of any text.
STAND_IN_DOCUMENT = {
    "position_applied": {"title": "Data engineer"},
    "self_evaluation": "Builds pipelines that others can run.",
    "skills_and_specialties": ["Python: batch jobs for 4 years", "SQL: models and tuning for 3 years"],
    "languages": [
        {"language": "English", "proficiency": "fluent", "certificates": [{"name": "IELTS", "score": "7.0", "issuing_organization": "British Council", "duration": "2022 - 2024"}]}
    ],
    "certifications": [],
    "work_experience": [
        {"company_name": "Blue Harbour", "company_description": "logistics", "position": "Data engineer", "duration": "2021 - 2024", "responsibilities": "Loads and checks of daily tables."}
    ],
    "basic_information": {"email": "someone@example.org", "phone": "0901234567", "location": "Hà Nội", "other_info": "example.org/someone"},
    "education_background": [{"university_name": "Open University", "degree": "BSc", "field_of_study": "Computing", "graduation_year": "2020"}],
    "projects": [{"project_name": "Warehouse", "description": "Moved reports to one table.", "duration": "2023"}],
}


class StandInExtractor:
    """Answers every prompt with the same document."""

    def generate(self, prompt: str, **context: object) -> str:
        return json.dumps(STAND_IN_DOCUMENT, ensure_ascii=False, indent=2)


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of token states ``(texts, tokens, width)`` over the tokens whose mask is 1; a text without any has zeros."""
    weight = mask[:, :, None].astype(float)
    return (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)


class TokenModel(Protocol):
    """Texts to states of their tokens and a mask of those that count."""

    def states(self, texts: list[str], most_tokens: int) -> tuple[np.ndarray, np.ndarray]: ...


class HashTokenModel:
    """Token states of signs hashed from each lower-case word."""

    def __init__(self, width: int = 32) -> None:
        self.width = width

    def states(self, texts: list[str], most_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        words = [t.lower().split()[:most_tokens] for t in texts]
        length = max(1, *map(len, words))
        out, mask = np.zeros((len(texts), length, self.width)), np.zeros((len(texts), length), dtype=int)
        for i, own in enumerate(words):
            mask[i, : len(own)] = 1
            for j, word in enumerate(own):
                out[i, j] = np.random.default_rng(zlib.crc32(word.encode())).choice((-1.0, 1.0), self.width)
        return out, mask


class PooledEmbedder:
    """The mean state of a text's tokens, ``batch`` texts at a time; a model's own limit of tokens is its feature."""

    def __init__(self, model: TokenModel, batch: int = 16, most_tokens: int = 512) -> None:
        self.model, self.batch, self.most_tokens = model, batch, most_tokens

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            out += mean_pooled(*self.model.states(texts[at : at + self.batch], self.most_tokens)).tolist()
        return out


class HashEmbedder:
    """Vectors of hashed tokens: equal texts are equal, texts that share tokens are near; a blank text is zero."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.width
            for token in text.lower().split():
                h = zlib.crc32(token.encode())
                vector[h % self.width] += 1.0 if h >> 16 & 1 else -1.0
            out.append(vector)
        return out


class TextParser:
    """Files that are text already."""

    def parse(self, name: str, content: bytes) -> tuple[str, list[str]]:
        return content.decode("utf-8", "replace"), []


class ParserChain:
    """The first parser whose text has a letter or digit; later ones add a warning that the text was read by them."""

    def __init__(self, parsers: list[Parser], note: str = "OCR Applied: the text layer was read by a fallback parser.") -> None:
        self.parsers, self.note = parsers, note

    def parse(self, name: str, content: bytes) -> tuple[str, list[str]]:
        text: str = ""
        warnings: list[str] = []
        for i, parser in enumerate(self.parsers):
            text, warnings = parser.parse(name, content)
            if any(c.isalnum() for c in text):
                return text, [self.note, *warnings] if i else warnings
        return text, warnings


def generate(prompts: DataFrame, factory: Callable[[], Generator], context: tuple[str, ...] = ()) -> DataFrame:
    """``prompts`` with the ``answer`` to each ``prompt``, or the ``error`` that it raised. ``context`` columns go with the prompt."""
    schema = f"{prompts._jdf.schema().toDDL()}, answer string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()

        def one(row: dict) -> tuple[str | None, str | None]:
            try:
                return model.generate(row["prompt"], **{c: row[c] for c in context}), None
            except Exception as failure:  # an answer that fails is a row that failed
                return None, f"{type(failure).__name__}: {failure}"

        for batch in batches:
            answers = [one(r) for r in batch.to_dict("records")]
            yield batch.assign(answer=[a for a, _ in answers], error=[e for _, e in answers])

    return prompts.mapInPandas(run, schema)


def embed(texts: DataFrame, factory: Callable[[], Embedder], text: str = "text", batch: int = 16) -> DataFrame:
    """``text, embedding`` of each distinct text: a text is embedded once, however often it comes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                yield part.assign(embedding=model.embed(part[text].fillna("").tolist()))

    return texts.select(text).distinct().mapInPandas(run, f"`{text}` string, embedding array<double>")


def embed_missing(known: DataFrame, texts: DataFrame, factory: Callable[[], Embedder], text: str = "text") -> DataFrame:
    """``known`` vectors and those of the texts that have none yet."""
    have = known.where("embedding IS NOT NULL").select(text, "embedding")
    return have.unionByName(embed(texts.join(have.select(text), text, "left_anti"), factory, text))
