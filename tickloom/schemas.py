"""Record schemas as DDL. Readers get them as they are: nothing is inferred, unknown JSON keys are ignored."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = "time timestamp_ntz, open double, high double, low double, close double, tick_volume bigint, real_volume bigint, spread bigint"
TICK = "time timestamp_ntz, time_msc bigint, bid double, ask double, last double, volume double, flags bigint"
FILL = (
    "id string, order_id string, deployment_id string, external_fill_id string, broker_mode string, side string, price string, "
    "quantity string, fee string, slippage string, filled_at string, created_at string"
)
LEDGER_ENTRY = "id string, paper_account_id string, deployment_id string, fill_id string, entry_type string, amount string, balance_after string, description string, created_at string"
EQUITY_POINT = "time timestamp_ntz, equity double"
DEAL = (
    "ticket bigint, order_ticket bigint, symbol string, price double, volume double, profit double, commission double, fee double, "
    "swap double, entry bigint, magic bigint, type bigint, time_msc bigint, comment string"
)
POSITION = (
    "ticket bigint, symbol string, type bigint, volume double, price_open double, price_current double, profit double, sl double, "
    "tp double, magic bigint, time bigint, comment string"
)
MANIFEST = (
    "dataset_id string, version bigint, state string, supersedes string, published_at string, row_count bigint, checksum_algorithm string, "
    "arrow_schema string, files array<string>, subject string, time_range struct<start: timestamp_ntz, end: timestamp_ntz>, tombstone string"
)
ENVELOPE = "topic string, epoch string, seq bigint, producer_id string, origin_ts string, payload_kind string, payload_schema string, schema_major bigint, payload string"
WALK_WINDOW = "index bigint, train_start timestamp_ntz, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz, status string"

#: The driver's tick table; its ids break ties between equal times.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

#: Money is exact: 38 digits, 18 of them after the point.
MONEY = T.DecimalType(38, 18)
