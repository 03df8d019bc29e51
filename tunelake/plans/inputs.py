"""Operator inputs derived from the driver tables.

Each input is one SELECT in the SQL that Spark and DuckDB share, so a query and its oracle
start from the same rows. `CHR` is used for characters whose literals differ.
"""

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def lit(text: str) -> str:
    """SQL text literal without escapes."""
    return "(" + " || CHR(39) || ".join(f"'{part}'" for part in text.split("'")) + ")"


def esc(column: str) -> str:
    """JSON string body of a text column."""
    out = column
    for code, to in ((92, "CHR(92) || CHR(92)"), (34, "CHR(92) || CHR(34)"),
                     (10, "CHR(92) || 'n'"), (13, "CHR(92) || 'r'"), (9, "CHR(92) || 't'")):
        out = f"replace({out}, CHR({code}), {to})"
    return out


def text_of(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def int_of(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


SOURCE_NO = "CAST(substr(source, 4) AS INT)"
EXT = f"CASE WHEN {SOURCE_NO} % 2 = 0 THEN '.json' ELSE '.jsonl' END"
HEAD = esc("substr(text, 1, 40)")
BODY = esc("text")

# one JSON record per document, in eight shapes
RECORD = f"""CASE doc_id % 8
  WHEN 0 THEN '{{"instruction": "' || {HEAD} || '", "input": "", "output": "' || {BODY} || '"}}'
  WHEN 1 THEN '{{"messages": [{{"role": "user", "content": "' || {HEAD} || '"}}, {{"role": "assistant", "content": "' || {BODY} || '"}}]}}'
  WHEN 2 THEN '{{"conversations": [{{"from": "human", "value": "' || {HEAD} || '"}}, {{"from": "gpt", "value": "' || {BODY} || '"}}]}}'
  WHEN 3 THEN '{{"prompt": "' || {HEAD} || '", "completion": "' || {BODY} || '"}}'
  WHEN 4 THEN '{{"text": "' || {BODY} || '"}}'
  WHEN 5 THEN '{{"payload": "' || {BODY} || '"}}'
  WHEN 6 THEN '{{"messages": [], "note": "' || {BODY} || '"}}'
  ELSE '{{"instruction": null, "output": "' || {BODY} || '"}}' END"""

LOSS = int_of("value * 100")
LOSS_TEXT = f"{text_of(int_of(f'{LOSS} / 10000'))} || '.' || lpad({text_of(f'{LOSS} % 10000')}, 4, '0')"
METRICS = (
    "CASE WHEN event_id % 29 = 0 THEN " + lit("{'other': 1} ") + " WHEN event_id % 23 = 0 THEN "
    + lit("INFO {no, dict} ") + " ELSE '' END || "
    + lit("{'loss': ") + f" || CASE WHEN event_id % 17 = 0 THEN {lit(chr(39) + 'nan' + chr(39))} "
    + f"WHEN event_id % 19 = 0 THEN 'None' WHEN event_id % 2 = 0 THEN CHR(39) || {LOSS_TEXT} || CHR(39) "
    + f"ELSE {LOSS_TEXT} END || " + lit(", 'grad_norm': '") + f" || {text_of(int_of('value'))} || "
    + lit(".5', 'learning_rate': 0.0001, 'epoch': ") + f" || {text_of('event_id % 10')} || " + "'}'"
)

FAMILY = """CASE p_type WHEN 'ECONOMY' THEN 'Qwen3' WHEN 'SMALL' THEN 'Llama-3' WHEN 'STANDARD' THEN 'Mistral'
  WHEN 'PROMO' THEN 'DeepSeek-R1' WHEN 'MEDIUM' THEN 'gemma-2' ELSE 'Bert' END"""
FAMILY_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'qwen2' WHEN 'SMALL' THEN 'llama' WHEN 'STANDARD' THEN 'mistral'
  WHEN 'PROMO' THEN 'qwen2' WHEN 'MEDIUM' THEN 'gemma2' ELSE 'bert' END"""
ORG = "'org' || substr(p_brand, 7)"
ENTRY = f"""CASE WHEN p_partkey % 11 = 0 THEN 'datasets--' ELSE 'models--' END || {ORG} || '--' || {FAMILY}
  || '--' || {text_of('p_size % 5')}"""

THINK = """CASE turn % 4
  WHEN 0 THEN '<think>' || substr(text, 1, 20) || '</think>' || substr(text, 21)
  WHEN 1 THEN substr(text, 1, 30) || '<think>' || substr(text, 31, 50) || '<think>' || substr(text, 81) || '</think>' || substr(text, 10, 20)
  WHEN 2 THEN text || '</think>' || substr(text, 1, 15) || '<thi'
  ELSE substr(text, 1, 40) || '<think>' || substr(text, 41) END"""

INPUTS = {
    # datasets ---------------------------------------------------------------
    "raw_records": f"""SELECT doc_id AS pos, source AS dataset, source || {EXT} AS file, {RECORD} AS record
        FROM documents""",
    "message_records": f"""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0
        THEN '{{"messages": [{{"role": "' || role || '", "content": "' || {BODY} || '"}}]}}'
        ELSE '{{"conversations": [{{"from": "' || CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END
             || '", "value": "' || {BODY} || '"}}]}}' END AS record
        FROM conversations""",
    "source_files": f"""SELECT DISTINCT d.source AS name, d.source || {EXT} AS file_name
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {SOURCE_NO} % 7 <> 6""",
    "registry": f"""SELECT name, CASE WHEN n % 5 = 0 THEN NULL ELSE name || ext END AS file_name,
        CASE WHEN n % 5 = 0 THEN 'https://hub.example.org/' || name END AS hf_hub_url,
        CASE WHEN n % 3 = 1 THEN 'alpaca' WHEN n % 3 = 2 THEN 'sharegpt' END AS formatting,
        CASE WHEN n % 6 = 2 THEN 'messages' WHEN n % 6 = 5 THEN 'conversations' END AS message_key,
        CASE WHEN n % 6 = 2 THEN 'role' WHEN n % 6 = 5 THEN 'from' END AS tag_style
        FROM (SELECT DISTINCT source AS name, {SOURCE_NO} AS n, {EXT} AS ext FROM documents) s WHERE n % 4 <> 3""",
    "incoming": f"""SELECT name, name || ext AS file_name, CAST(NULL AS STRING) AS hf_hub_url, 'sharegpt' AS formatting,
        'messages' AS message_key, 'role' AS tag_style
        FROM (SELECT DISTINCT source AS name, {SOURCE_NO} AS n, {EXT} AS ext FROM documents) s WHERE n % 3 <> 0""",
    "dataset_documents": f"""SELECT 'doc_' || {text_of('doc_id')} || '.json' AS file, doc_id, CASE doc_id % 3
          WHEN 0 THEN '[' || record || ', ' || record || ']'
          WHEN 1 THEN record
          ELSE record || CHR(10) || record || CHR(10) END AS content
        FROM (SELECT doc_id, {RECORD} AS record FROM documents) r""",
    "folder_names": f"""SELECT CASE doc_id % 10 WHEN 0 THEN '.' || {text_of('doc_id')} || '.json'
          WHEN 1 THEN {text_of('doc_id')} || '.txt' WHEN 2 THEN 'dataset_info.json' WHEN 3 THEN 'README.txt'
          WHEN 4 THEN {text_of('doc_id')} || '.jsonl' ELSE {text_of('doc_id')} || '.json' END AS file_name,
        source AS folder, n_chars AS length FROM documents""",
    # models -----------------------------------------------------------------
    "cache": f"""SELECT {ENTRY} AS entry, 'snap' || {text_of('p_partkey % 3')} AS snapshot,
        CASE p_partkey % 5 WHEN 0 THEN 'model-' || {text_of('p_partkey')} || '.safetensors'
          WHEN 1 THEN 'model-' || {text_of('p_partkey')} || '.bin' WHEN 2 THEN 'config.json'
          WHEN 3 THEN 'tokenizer_config.json' ELSE 'notes-' || {text_of('p_partkey')} || '.md' END AS file_name,
        CAST(p_size AS BIGINT) * 100000007 AS length FROM part""",
    "cache_configs": f"""SELECT DISTINCT {ENTRY} AS entry, 'snap' || {text_of('p_partkey % 3')} AS snapshot,
        CASE p_partkey % 5 WHEN 2 THEN 'config.json' ELSE 'tokenizer_config.json' END AS file_name,
        CASE WHEN p_partkey % 5 = 2 AND p_size % 5 = 4 THEN '{{"architectures": []}}'
          WHEN p_partkey % 5 = 2 AND p_size % 5 = 3 THEN 'not json'
          WHEN p_partkey % 5 = 2 THEN '{{"model_type": "' || {FAMILY_TYPE} || '"}}'
          ELSE '{{"add_bos": true, "tokenizer_class": "' || CASE WHEN p_size % 5 < 3 THEN 'LlamaTokenizerFast' ELSE 'Qwen2TokenizerFast' END
            || '"}}' END AS content
        FROM part WHERE p_partkey % 5 IN (2, 3)""",
    "adapter_configs": f"""SELECT 'saves/run_' || {text_of('o_orderkey')} || '/lora' AS path,
        CASE WHEN o_orderkey % 13 = 0 THEN '{{"base_model_name_or_path": ""}}' WHEN o_orderkey % 17 = 0 THEN 'broken'
          ELSE '{{"base_model_name_or_path": "org' || {text_of('o_custkey % 25 + 1')} || '/Qwen3/' || {text_of('o_custkey % 5')} || '"}}' END AS content
        FROM orders""",
    "workspace_files": f"""SELECT 'work/models/' || p_brand || '/' || CASE p_partkey % 3 WHEN 0 THEN 'config.json'
          WHEN 1 THEN 'deep/config.json' ELSE 'weights-' || {text_of('p_partkey')} || '.bin' END AS path,
        CAST(p_size AS BIGINT) AS length FROM part
        UNION ALL SELECT 'work/saves/run_' || {text_of('o_orderkey')} || CASE o_orderkey % 3 WHEN 0 THEN '/lora/adapter_config.json'
          WHEN 1 THEN '/train.log' ELSE '/lora/weights.bin' END AS path, o_orderkey AS length FROM orders""",
    "catalogue": f"""SELECT p_brand || '/' || replace(p_name, ' ', '-') || '-' || {text_of('p_partkey')} AS id,
        CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE sold END AS downloads, CAST(p_size AS BIGINT) AS likes,
        CASE p_partkey % 4 WHEN 0 THEN 'pytorch,text-generation' WHEN 1 THEN 'pytorch' END AS tag_text,
        CASE WHEN p_partkey % 5 = 0 THEN 'text-generation' WHEN p_partkey % 5 = 1 THEN 'translation' END AS pipeline_tag
        FROM part p LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS sold FROM lineitem GROUP BY l_partkey) s
          ON p.p_partkey = s.l_partkey""",
    # training logs ----------------------------------------------------------
    "log_lines": f"""SELECT 'run_' || {text_of('user_id')} AS run, event_id AS line_no, CASE
          WHEN event_type IN ('click', 'view') THEN {METRICS}
          WHEN event_type = 'signup' THEN 'Total optimization steps = ' || {text_of(int_of('value * 10'))}
          WHEN event_type = 'error' THEN {lit("{'eval_loss': 0.5, 'epoch': 1}")}
          ELSE 'Saving model checkpoint to saves/run_' || {text_of('user_id')} || '/checkpoint-' || {text_of(int_of('value') + ' % 30')} END AS line
        FROM events""",
    "checkpoint_paths": f"""SELECT DISTINCT 'run_' || {text_of('user_id')} AS run,
        'saves/run_' || {text_of('user_id')} || '/checkpoint-' || {text_of(int_of('value') + ' % 30')} AS path
        FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT DISTINCT 'run_' || {text_of('user_id')} AS run, 'saves/run_' || {text_of('user_id')} || '/lora' AS path FROM events""",
    "exits": f"""SELECT 'run_' || {text_of('user_id')} AS run, max(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS exit_code
        FROM events GROUP BY user_id""",
    # chat -------------------------------------------------------------------
    "answers": f"""SELECT conv_id, turn, replace(replace({THINK}, ' ', 'Ġ'), CHR(10), 'Ċ') AS text FROM conversations""",
    "commands": f"""SELECT user_id, event_id AS seq, CASE
          WHEN event_type = 'signup' THEN '/clear' WHEN event_type = 'error' THEN '   '
          WHEN event_type = 'purchase' AND value > 60 THEN CASE WHEN event_id % 2 = 0 THEN '/quit' ELSE '/exit' END
          ELSE '  ' || event_type || ' ' || {text_of('event_id')} END AS text FROM events""",
    # runs -------------------------------------------------------------------
    "finished": f"""SELECT o_orderkey AS seq, 'run_' || {text_of('o_orderkey % 4000')} AS run,
        'org/model-' || {text_of('o_custkey')} AS model,
        CASE WHEN o_orderkey % 3 = 0 THEN ' data-' || {text_of('o_custkey % 9')} || ' , extra,' ELSE 'data-' || {text_of('o_custkey % 9')} END AS dataset,
        'sft' AS stage, CAST(o_orderkey % 5 AS DOUBLE) AS epochs,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'qwen3' END AS template, o_orderstatus <> 'F' AS success, o_orderdate AS finished_at
        FROM orders""",
    "config_entries": f"""SELECT 'run_' || {text_of('p_partkey')} AS run, 'template' AS key, p_brand AS value FROM part
        UNION ALL SELECT 'run_' || {text_of('p_partkey')}, 'stage', p_type FROM part
        UNION ALL SELECT 'run_' || {text_of('p_partkey')}, 'output_dir', p_name FROM part
        UNION ALL SELECT 'run_' || {text_of('p_partkey')}, 'cutoff_len', {text_of('p_size')} FROM part WHERE p_size > 10
        UNION ALL SELECT 'run_' || {text_of('p_partkey')}, 'dataloader_pin_memory', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END FROM part""",
    "config_documents": f"""SELECT 'run_' || {text_of('p_partkey')} AS run,
        '# run manifest' || CHR(10) || '# ---' || CHR(10) || '#   command: quick_train' || CHR(10) || '#   cli_args.model: ' || p_brand || CHR(10)
        || '#   random_seed: ' || {text_of('p_partkey * 7')} || CHR(10)
        || 'bf16: true' || CHR(10) || 'dataset: ' || CHR(39) || p_name || CHR(39) || CHR(10) || 'empty: ' || CHR(10)
        || 'cutoff_len: ' || {text_of('p_size')} || CHR(10) || 'output_dir: saves/run_' || {text_of('p_partkey')} || '/lora' || CHR(10)
        || 'noted: ' || p_brand || '  # ' || p_type || CHR(10) || CHR(39) || 'quoted key' || CHR(39) || ': ' || p_brand || '#1' || CHR(10)
        || 'folded: ' || p_name || CHR(10) || '  ' || p_type || CHR(10) || '  ' || p_brand || CHR(10)
        || 'escaped: "' || p_brand || CHR(92) || 'n' || p_type || CHR(92) || 'u00e9 ' || CHR(92) || '"' || p_name || CHR(92) || '""' || CHR(10) AS content
        FROM part""",
    "sweep": f"""SELECT 'run_' || {text_of('p_partkey')} AS run, p_brand AS model, 'qwen3' AS template, p_name AS dataset, '3.0' AS epochs,
        CASE p_partkey % 3 WHEN 0 THEN 'freeze' ELSE 'lora' END AS method,
        CASE WHEN p_size > 25 THEN {text_of('p_size')} END AS lora_rank, CAST(NULL AS STRING) AS lora_dropout,
        {text_of('p_size % 3')} AS lora_alpha, CASE WHEN p_size % 4 = 0 THEN '5e-05' END AS learning_rate,
        CASE WHEN p_size % 6 = 0 THEN '1.0' END AS param_epochs, CASE WHEN p_size % 7 = 0 THEN '1' END AS batch_size,
        CAST(NULL AS STRING) AS grad_accum, CASE WHEN p_size % 5 = 0 THEN '1024' END AS cutoff_len, CAST(NULL AS STRING) AS warmup_ratio,
        CASE WHEN p_size % 9 = 0 THEN '0.5' END AS target_loss, 'false' AS bf16,
        CASE WHEN p_size % 2 = 0 THEN 'true' END AS fp16, '8' AS workers, 'true' AS pin_memory,
        {text_of('p_partkey * 7')} AS seed FROM part""",
    "states": f"""SELECT o_orderkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'org/model-' || {text_of('o_custkey')} END AS active_model,
        CAST(NULL AS STRING) AS active_adapter, CASE WHEN o_orderkey % 3 = 0 THEN 'llama3' END AS active_template,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS active_dataset, CASE WHEN o_orderkey % 7 = 0 THEN 'light' END AS theme,
        CASE WHEN o_orderkey % 4 = 0 THEN '["run_' || {text_of('o_orderkey')} || '"]' END AS training_history
        FROM orders""",
    # a state file per part: sound, with an open quote, with text behind a quote, or absent
    "state_documents": f"""SELECT 'state_' || {text_of('p_partkey')} || '.yaml' AS file, CASE p_partkey % 4
          WHEN 1 THEN 'active_model: "' || p_brand || CHR(10) || 'theme: dark' || CHR(10)
          WHEN 2 THEN 'theme: ' || CHR(39) || p_type || CHR(39) || ' ' || p_brand || CHR(10)
          ELSE '# state' || CHR(10) || 'active_model: ' || p_name || CHR(10) || '  ' || p_type || CHR(10) || 'theme: "' || p_brand || '" # set' || CHR(10) END AS content
        FROM part WHERE p_partkey % 4 <> 3""",
    # usage ------------------------------------------------------------------
    "disk_files": f"""SELECT CASE {SOURCE_NO} % 5 WHEN 0 THEN 'data' WHEN 1 THEN 'yaml' WHEN 2 THEN 'saves' WHEN 3 THEN 'models' ELSE 'other' END AS directory,
        CASE WHEN doc_id % 20 = 0 THEN NULL ELSE n_chars * 1000 END AS length FROM documents""",
    "page_files": """SELECT split_part(url, '/', 3) AS repo_id,
        CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 0 ELSE CAST(length(html) AS BIGINT) * 100 END AS length FROM pages""",
    "download_log": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'GatedRepoError' WHEN 1 THEN 'RepositoryNotFoundError' WHEN 2 THEN 'HTTPError'
          WHEN 3 THEN 'ConnectionError' WHEN 4 THEN 'OSError' WHEN 5 THEN 'Timeout' WHEN 6 THEN 'HTTPError' ELSE 'ValueError' END AS exception,
        CASE WHEN event_id % 8 = 2 THEN CASE event_id % 3 WHEN 0 THEN 401 WHEN 1 THEN 403 ELSE 404 END
          WHEN event_id % 8 = 6 THEN 500 END AS status,
        CASE WHEN user_id % 3 = 0 THEN 'No Space left on device' WHEN user_id % 3 = 1 THEN 'Disk quota' ELSE 'other ' || event_type END AS message
        FROM events""",
}


def with_inputs(body: str, *names: str) -> str:
    """A statement whose inputs are defined in front of it."""
    if not names:
        return body
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names) + " " + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a DataFrame."""
    sql = INPUTS[name]
    for t in TABLES:
        if f"FROM {t}" in sql or f"JOIN {t}" in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)
