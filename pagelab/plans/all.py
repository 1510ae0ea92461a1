"""Import every query module so the registry is complete.

Order matters for readers of ``queries()``: the SQL-checked families come
first, the slower model-training families last.
"""

from pagelab.plans import q_pages  # noqa: F401  A, B, C
from pagelab.plans import q_dom  # noqa: F401  D
from pagelab.plans import q_text  # noqa: F401  E
from pagelab.plans import q_profile  # noqa: F401  F, I
from pagelab.plans import q_eval  # noqa: F401  G13, H
from pagelab.plans import q_stream  # noqa: F401  L
from pagelab.plans import q_models  # noqa: F401  G, H loops, J
from pagelab.plans.registry import ORACLE, QUERIES  # noqa: F401
