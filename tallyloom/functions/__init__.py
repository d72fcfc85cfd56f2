from tallyloom.functions.expr import (  # noqa: F401
    finite_or_null, hash_key, percent_text, rounded, safe_div, unit_interval,
)
from tallyloom.functions.scale import (  # noqa: F401
    bounded_rows, hash_rank, join_small, materialise, running_total, split_hot, store, work_dir,
)
