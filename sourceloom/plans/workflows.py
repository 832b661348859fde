"""The two workflows end to end: build the knowledge base, prepare and finish messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.operators import changes as C
from sourceloom.operators import kb as K
from sourceloom.operators import prompts as R
from sourceloom.operators.extract.shapes import ARRAYS
from sourceloom.session import written


def category_report(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Analysed files per repository and category."""
    good, _ = K.quarantine(K.build(K.candidates(files, patterns), ["imports"]))
    return good.groupBy("repo", "category").agg(F.count("*").alias("n_files"))


@dataclass
class KnowledgeBase:
    """The tables of one build; ``built`` should be written before wide reuse.

    ``kinds`` names the arrays to extract, all by default.
    """

    files: DataFrame
    patterns: DataFrame
    kinds: tuple[str, ...] = tuple(ARRAYS)

    @property
    def built(self) -> DataFrame:
        return K.build(K.candidates(self.files, self.patterns), self.kinds)

    @property
    def good(self) -> DataFrame:
        return K.quarantine(self.built)[0]

    def lookup(self) -> DataFrame:
        """Per file the context block that a lookup of its path answers.

        Blocks are made once and written: the winners and their blocks are both read from there.
        """
        blocks = written(R.file_block(self.good), "kb-blocks")
        return C.lookup_table(self.files, K.survivors(blocks, ("block",)))


def draft_prompts(kb: KnowledgeBase, changes: DataFrame, diffs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Prompts per commit: lookup, scope, context and diff; ``extra`` has ``commit_id, additional_context``."""
    context = C.change_context(R.with_parts(changes), kb.lookup())
    scopes = C.commit_scope(C.with_paths(changes, kb.files))
    return R.render_prompts(diffs, R.context_text(context), scopes, extra)
