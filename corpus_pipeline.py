"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, packing."""

from kinloom.llm.queries import STAGES, run_stages

#: Learned rules, exact components and packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; the rows of the last one."""
    return run_stages(spark, sf_dir, STAGES)
