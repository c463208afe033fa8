"""Every query of the library outside the training-data subpackage, with its SQL."""

from __future__ import annotations

from quillspan.plans import blocks, cleaning, cohort, evaluation, features, inputs, modelling, sequences

QUERIES: dict = {}
SQL: dict = {}
for module in (cleaning, evaluation, sequences, cohort, features, inputs, blocks, modelling):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
