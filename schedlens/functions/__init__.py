from schedlens.functions.exprs import (  # noqa: F401
    bucket_5min,
    bucket_daily,
    clamped_period,
    event_join_time,
    idiv,
    machine_event_join_time,
    merge_struct,
    saturating_add,
    typed_struct,
    usage_join_time,
    zero,
)
