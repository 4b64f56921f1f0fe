"""What a language model would judge or write, behind columns; the defaults are deterministic, native and offline.

A provider maps columns to columns, so that any of them can be replaced by a Pandas UDF that calls a model. The defaults
reproduce plumbing, failure values and thresholds, not a model's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import sentences, tokens
from lodestone.functions.text import once

#: Labels of routes and the namespaces that they read.
ROUTES = (("technical", "props"), ("conceptual", "raptor-l2"), ("howto", "parent"), ("precise", "leaf"))
#: The descriptions of routes, the prototypes that questions are compared with.
ROUTE_WORDS = {
    "technical": "specific API calls, method signatures, code examples, parameters, configuration options, error messages",
    "conceptual": "high-level overviews, architecture explanations, what something is, comparisons, design decisions",
    "howto": "step-by-step guides, tutorials, how to accomplish a task, setup instructions, walkthroughs",
    "precise": "exact fact lookup, specific version info, precise definitions, narrow technical details",
}
DEFAULT_ROUTE = "precise"


class Offline:
    """The default provider."""

    name = "offline"

    def propositions(self, text: Column) -> Column:
        """All sentences."""
        return sentences(text)

    def triples(self, sentence: Column) -> Column:
        """[subject, relation, object]: a sentence's first three words without punctuation; null for shorter ones."""
        words = F.filter(F.transform(F.slice(tokens(F.lower(sentence)), 1, 3), lambda w: F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", "")), lambda w: w != "")
        return once(words, lambda w: F.when(F.size(w) == 3, w))

    def complexity(self, question: Column) -> Column:
        n = F.size(tokens(question))
        return F.when(n <= 8, "simple").when(n <= 24, "moderate").otherwise("complex")

    def decompose(self, question: Column) -> Column:
        """All the question's sentences; the question itself where there is none."""
        return once(sentences(question), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(question)))

    def containment(self, inner: Column, outer: Column) -> Column:
        """Share of inner's distinct words that outer has; 0 for none."""
        a = F.array_distinct(tokens(F.lower(inner)))
        return F.when(F.size(a) > 0, F.size(F.array_intersect(a, tokens(F.lower(outer)))) / F.size(a)).otherwise(0.0)

    def hyde(self, question: Column) -> Column:
        """A text that could answer the question; offline the question stands for it."""
        return question

    def entities(self, question: Column) -> Column:
        """What the question may be about: its distinct words, lower-cased, without punctuation around them."""
        bare = F.transform(tokens(F.lower(question)), lambda w: F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))
        return F.array_distinct(F.filter(bare, lambda w: w != ""))

    def label(self, question: Column) -> Column:
        """The label of a route; null where none is plain."""
        q = F.lower(question)
        return F.when(q.rlike(r"^how (to|do|can)\b"), "howto").when(q.rlike(r"^(what is|why|compare)\b"), "conceptual").when(q.rlike(r"error|\(\)|parameter|option"), "technical")

    def answer(self, question: Column, texts: Column, most: int) -> Column:
        """An answer from texts in the order of their relevance; '' without any."""
        return self.summary(texts, most)

    def synthesize(self, questions: Column, answers: Column) -> Column:
        """One answer of those to the parts of a question."""
        return F.array_join(answers, "\n\n")

    def refine(self, question: Column, answer: Column, issues: Column) -> Column:
        """A better query: the question's words that the answer lacks; the question where it lacks none."""
        missing = F.array_except(tokens(F.lower(question)), tokens(F.lower(answer)))
        return F.when(F.size(missing) > 0, F.array_join(missing, " ")).otherwise(question)

    def stream(self, text: str) -> Iterator[str]:
        """An answer as tokens that make it up."""
        for k, word in enumerate(text.split(" ")):
            yield word if not k else f" {word}"

    def summary(self, texts: Column, most: int) -> Column:
        """The first sentences of the first ``most`` texts."""
        return F.array_join(F.filter(F.transform(F.slice(texts, 1, most), lambda t: sentences(t)[0]), lambda s: s.isNotNull()), " ")


OFFLINE = Offline()
