"""DuckDB statement of the fixture chain (FIXTURES.md §3), used by the
oracle SQL of every registered query.

This is an independent, plain-SQL restatement of the formulas in
``sources/fixture.py`` over the driver's ``events`` view; each oracle query is
``ORACLE_PREFIX`` followed by its own SELECT. Milliseconds are floored with
``epoch_us(ts) // 1000`` (DuckDB's ``epoch_ms`` rounds, decision D5).
"""

ORACLE_PREFIX = r"""
WITH
o_ev0 AS (
  SELECT event_id AS k,
         event_id // 20 AS block_number,
         event_id % 20 AS event_index,
         CASE WHEN event_id % 20 = 19 AND (event_id // 20) % 2 = 1 THEN 1
              WHEN event_id % 20 = 0 AND (event_id // 20) % 3 = 0 THEN 2 ELSE 0 END AS phase,
         CASE WHEN event_id % 20 = 19 AND (event_id // 20) % 2 = 1 THEN NULL
              WHEN event_id % 20 = 0 AND (event_id // 20) % 3 = 0 THEN NULL
              ELSE (event_id % 20) // 4 END AS extrinsic_index,
         epoch_us(ts) // 1000 AS ts_ms,
         user_id,
         CASE event_type WHEN 'purchase' THEN 'Balances' WHEN 'signup' THEN 'System'
              WHEN 'error' THEN 'System' WHEN 'click' THEN 'Utility'
              WHEN 'view' THEN 'TransactionPayment' END AS mod_name,
         CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'Withdraw'
              WHEN event_type = 'purchase' THEN 'Transfer'
              WHEN event_type = 'signup' THEN 'ExtrinsicSuccess'
              WHEN event_type = 'error' THEN 'ExtrinsicFailed'
              WHEN event_type = 'click' THEN 'ItemCompleted'
              WHEN event_type = 'view' THEN 'TransactionFeePaid' END AS event_name,
         CAST(round(value * 100) AS BIGINT) AS amount,
         props
  FROM events
),
o_ev AS (
  SELECT *,
    CASE
      WHEN event_name = 'Transfer' THEN '{"from":"0x' || sha256('acct-' || user_id) || '","to":"0x'
           || sha256('acct-' || ((user_id * 7 + 1) % 150)) || '","amount":' || amount || '}'
      WHEN event_name = 'Withdraw' THEN '{"who":"0x' || sha256('acct-' || user_id)
           || '","amount":' || amount || '}'
      WHEN event_name = 'TransactionFeePaid' THEN '{"who":"0x' || sha256('acct-' || user_id)
           || '","actual_fee":' || amount || '}'
      WHEN event_name = 'ItemCompleted' AND k % 41 = 0 THEN NULL
      ELSE props END AS vals
  FROM o_ev0
),
o_chain AS (SELECT * FROM (VALUES ('polkadot', ''), ('kusama', 'ksm-')) t(chain, pfx)),
o_evc AS (
  SELECT c.chain, c.pfx, e.*
  FROM o_ev e JOIN o_chain c ON c.chain = 'polkadot' OR e.block_number % 2 = 0
),
o_blk AS (
  SELECT chain, pfx, block_number, max(ts_ms) AS ts_ms
  FROM o_evc GROUP BY chain, pfx, block_number
),
o_ok AS (
  SELECT chain, block_number, extrinsic_index,
         bool_or(mod_name = 'System' AND event_name = 'ExtrinsicSuccess') AS ok
  FROM o_evc WHERE extrinsic_index IS NOT NULL GROUP BY chain, block_number, extrinsic_index
),
o_blocks AS (
  SELECT chain, block_number AS number, ts_ms AS "timestamp",
    '0x' || sha256(pfx || 'block-' || block_number) AS hash,
    CASE WHEN block_number % 50 = 7 THEN '0x' || sha256(pfx || 'fork-' || block_number)
         ELSE '0x' || sha256(pfx || 'block-' || (block_number - 1)) END AS parent_hash,
    '0x' || sha256(pfx || 'xroot-' || block_number) AS extrinsics_root,
    '0x' || sha256(pfx || 'state-' || block_number) AS state_root,
    true AS is_finalized,
    CASE WHEN block_number % 7 = 0 THEN NULL
         ELSE '0x' || sha256(pfx || 'validator-' || (block_number % 13)) END AS validator,
    CAST(9000 + 10 * (block_number // 150) AS INTEGER) AS spec_version
  FROM o_blk
),
o_events AS (
  SELECT e.chain, e.block_number || '-' || e.event_index AS id, e.block_number,
    e.block_number || '-' || e.extrinsic_index AS extrinsic_id, e.mod_name, e.event_name,
    CAST(e.phase AS SMALLINT) AS phase, e.vals AS "values", b.ts_ms AS block_timestamp,
    '0x' || sha256(e.pfx || 'ext-' || (e.block_number * 5 + e.extrinsic_index)) AS extrinsic_hash,
    e.event_index, e.extrinsic_index, coalesce(ok.ok, false) AS extrinsic_success,
    e.user_id, e.amount, e.k
  FROM o_evc e
  JOIN o_blk b ON b.chain = e.chain AND b.block_number = e.block_number
  LEFT JOIN o_ok ok ON ok.chain = e.chain AND ok.block_number = e.block_number
                   AND ok.extrinsic_index = e.extrinsic_index
),
o_extrinsics AS (
  SELECT b.chain, b.block_number || '-' || r.i AS id, b.block_number,
    '0x' || CASE WHEN r.i = 5 THEN sha256(b.pfx || 'ext5-' || b.block_number)
                 ELSE sha256(b.pfx || 'ext-' || (b.block_number * 5 + r.i)) END AS extrinsic_hash,
    r.i <> 0 AS is_signed,
    CASE WHEN r.i = 0 THEN 'Timestamp'
         ELSE (['Balances', 'Utility', 'Staking'])[(b.block_number + r.i) % 3 + 1] END AS mod_name,
    CASE WHEN r.i = 0 THEN 'set'
         ELSE (['transfer_keep_alive', 'batch', 'bond'])[(b.block_number + r.i) % 3 + 1] END AS call_name,
    coalesce(ok.ok, false) AS result,
    '{"block":' || b.block_number || ',"index":' || r.i || '}' AS call_params,
    b.ts_ms AS block_timestamp, r.i AS extrinsic_index,
    CASE WHEN r.i = 0 THEN NULL ELSE '0x' || sha256('acct-' || ((b.block_number + r.i) % 150)) END AS signer
  FROM o_blk b
  CROSS JOIN (SELECT range AS i FROM range(6)) r
  LEFT JOIN o_ok ok ON ok.chain = b.chain AND ok.block_number = b.block_number
                   AND ok.extrinsic_index = r.i
  WHERE r.i < 5 OR b.block_number % 4 = 0
),
o_logs0 AS (
  SELECT b.chain, b.pfx, b.block_number, t.ord, t.type
  FROM o_blk b
  CROSS JOIN (VALUES (0, 'PreRuntime'), (1, 'Seal'), (2, 'Consensus'), (3, 'Other'),
                     (4, 'RuntimeEnvironmentUpdated')) t(ord, type)
  WHERE b.block_number % 53 <> 0
    AND (t.ord < 2 OR (t.ord = 2 AND b.block_number % 5 = 0)
         OR (t.ord = 3 AND b.block_number % 11 = 0) OR (t.ord = 4 AND b.block_number % 50 = 0))
),
o_logs AS (
  SELECT chain, block_number || '-' || (row_number() OVER (PARTITION BY chain, block_number ORDER BY ord) - 1) AS id,
    block_number, type,
    CASE type WHEN 'PreRuntime' THEN '0x' || sha256(pfx || 'pre-' || block_number)
              WHEN 'Seal' THEN '0x' || sha256(pfx || 'seal-' || block_number)
              WHEN 'Consensus' THEN '0x' || sha256(pfx || 'beef-' || block_number)
              WHEN 'Other' THEN '0x' || sha256(pfx || 'other-' || block_number) END AS data,
    CASE WHEN type IN ('PreRuntime', 'Seal') THEN 'BABE'
         WHEN type = 'Consensus' AND block_number % 25 <> 0 THEN 'BEEF' END AS engine,
    row_number() OVER (PARTITION BY chain, block_number ORDER BY ord) - 1 AS log_index
  FROM o_logs0
),
o_transfers AS (
  SELECT chain, block_number, event_index AS "index", id, extrinsic_id, extrinsic_index,
    extrinsic_hash, block_timestamp,
    json_extract_string("values", '$.from') AS "from",
    json_extract_string("values", '$.to') AS "to",
    CAST(json_extract_string("values", '$.amount') AS DECIMAL(38,0)) AS amount,
    extrinsic_success AS success
  FROM o_events WHERE mod_name = 'Balances' AND event_name = 'Transfer'
),
o_withdrawals AS (
  SELECT chain, block_number, event_index AS "index", id, extrinsic_id, extrinsic_index,
    extrinsic_hash, block_timestamp,
    json_extract_string("values", '$.who') AS who,
    CAST(json_extract_string("values", '$.amount') AS DECIMAL(38,0)) AS amount,
    extrinsic_success AS success
  FROM o_events WHERE mod_name = 'Balances' AND event_name = 'Withdraw'
),
o_raw AS (
  SELECT block_number, '0x' || sha256('block-' || block_number) AS block_hash,
    CAST(0 AS BIGINT) AS block_time,
    '0x' || sha256('ext-' || (block_number * 5 + extrinsic_index)) AS extrinsic_hash,
    '0x' || sha256('data-' || k) AS data, CAST(event_index AS INTEGER) AS "index",
    CASE WHEN k % 7 > 0 THEN '0x' || sha256('topic-' || k || '-0') ELSE '' END AS topic0,
    CASE WHEN k % 7 > 1 THEN '0x' || sha256('topic-' || k || '-1') ELSE '' END AS topic1,
    CASE WHEN k % 7 > 2 THEN '0x' || sha256('topic-' || k || '-2') ELSE '' END AS topic2,
    CASE WHEN k % 7 > 3 THEN '0x' || sha256('topic-' || k || '-3') ELSE '' END AS topic3,
    CASE WHEN k % 7 > 4 THEN '0x' || sha256('topic-' || k || '-4') ELSE '' END AS topic4,
    CASE phase WHEN 1 THEN 'Finalization' WHEN 2 THEN 'Initialization'
         ELSE 'ApplyExtrinsic(' || extrinsic_index || ')' END AS phase,
    mod_name AS pallet_name,
    CAST(CASE mod_name WHEN 'System' THEN 0 WHEN 'Balances' THEN 5 WHEN 'Utility' THEN 26
                       WHEN 'TransactionPayment' THEN 32 END AS SMALLINT) AS pallet_index,
    event_name, k % 7 AS n_topics
  FROM o_ev
),
o_bad_envelopes AS (
  SELECT DISTINCT event_id // 20 AS b, ((event_id // 20) // 37) % 6 AS kind FROM events WHERE (event_id // 20) % 37 = 5
),
o_bad_blocks AS (
  SELECT DISTINCT event_id // 20 AS b, ((event_id // 20) // 41) % 3 AS kind FROM events WHERE (event_id // 20) % 41 = 7
),
p_blocks AS (SELECT * FROM o_blocks WHERE chain = 'polkadot'),
p_events AS (SELECT * FROM o_events WHERE chain = 'polkadot'),
p_extrinsics AS (SELECT * FROM o_extrinsics WHERE chain = 'polkadot'),
p_logs AS (SELECT * FROM o_logs WHERE chain = 'polkadot'),
p_transfers AS (SELECT * FROM o_transfers WHERE chain = 'polkadot'),
p_withdrawals AS (SELECT * FROM o_withdrawals WHERE chain = 'polkadot')
"""


def oracle(body: str) -> str:
    """Prefix a query body (starting with SELECT or further CTEs ``, x AS``)."""
    body = body.strip()
    if body.startswith(","):
        return ORACLE_PREFIX + body
    return ORACLE_PREFIX + "\n" + body
