"""From raw documents to token ids: quality, near-duplicates, secrets, mixing, BPE."""

from weftline.llm.stages import STAGES, run

#: SQL can't express the classifier, the near-duplicates' hashing or BPE; tests compare with brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
