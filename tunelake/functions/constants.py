"""Fixed values.

These must equal the values users already rely on (file formats, tag names, model
families, defaults), so they are stated plainly, as text.
"""

# --- chat record tags -------------------------------------------------------
TAG_FIELDS = ["role_tag", "content_tag", "user_tag", "assistant_tag", "system_tag"]
ROLE_TAGS = {
    "role_tag": "role",
    "content_tag": "content",
    "user_tag": "user",
    "assistant_tag": "assistant",
    "system_tag": "system",
}
FROM_TAGS = {
    "role_tag": "from",
    "content_tag": "value",
    "user_tag": "human",
    "assistant_tag": "gpt",
    "system_tag": "system",
}

# --- data folder ------------------------------------------------------------
REGISTRY_FILE = "dataset_info.json"
IGNORED_FILES = [REGISTRY_FILE, "README.txt"]

# --- model families ---------------------------------------------------------
TEXT_GENERATION_TYPES = [
    "qwen2", "qwen3", "qwen3_moe", "qwen2_vl", "qwen2_audio", "qwen2_5_vl",
    "llama", "mistral", "gemma", "gemma2", "gemma3_text", "gemma3",
    "gpt_neox", "gpt2", "gpt_bigcode", "gpt_oss", "gptj",
    "falcon", "phi", "phi3", "phi4",
    "stablelm", "baichuan", "deepseek", "deepseek_v2", "deepseek_v3",
    "internlm2", "chatglm", "bloom", "mpt", "olmo", "olmo2", "olmoe",
    "cohere", "cohere2", "dbrx", "mixtral",
    "exaone", "arctic", "jamba", "mamba", "mamba2",
    "nemotron", "minicpm", "minicpm3", "minicpmo",
    "llava", "llava_next", "pixtral", "paligemma",
    "xverse", "yuan", "orion", "skywork",
    "command_r", "dolly",
    "refinedweb", "rwkv", "rwkv6", "rwkv7",
    "plamo2",
    "cogvlm", "cogvlm2",
]

TEMPLATE_BY_TYPE = {
    "qwen3": "qwen3",
    "qwen3_moe": "qwen3",
    "qwen2": "qwen",
    "qwen2_vl": "qwen2_vl",
    "qwen2_audio": "qwen2_audio",
    "llama": "llama3",
    "mistral": "mistral",
    "gemma": "gemma",
    "gemma2": "gemma",
    "gemma3": "gemma3",
    "gemma3_text": "gemma3",
    "deepseek": "deepseek",
    "deepseek_v2": "deepseek",
    "deepseek_v3": "deepseek3",
    "phi": "phi",
    "phi3": "phi",
    "phi4": "phi4",
    "internlm2": "internlm2",
    "chatglm": "chatglm3",
    "baichuan": "baichuan",
    "falcon": "falcon",
    "yi": "yi",
}

REASONING_MARKS = ["deepseek-r1", "deepseekr1"]
REASONING_TEMPLATE = "deepseekr1"

# (substrings, template), tried in this order on the lower-cased repo id
TEMPLATE_BY_NAME = [
    (["qwen3"], "qwen3"),
    (["qwen2"], "qwen2"),
    (["qwen"], "qwen3"),
    (["llama-4", "llama4"], "llama4"),
    (["llama-3", "llama3"], "llama3"),
    (["llama-2", "llama2"], "llama2"),
    (["mistral"], "mistral"),
    (["gemma-3", "gemma3"], "gemma3"),
    (["gemma-2", "gemma2"], "gemma"),
    (["gemma"], "gemma"),
    (["deepseek-v3", "deepseekv3"], "deepseek3"),
    (["deepseek-v2", "deepseekv2"], "deepseek"),
    (["deepseek"], "deepseek"),
    (["phi-4", "phi4"], "phi4"),
    (["phi"], "phi"),
    (["falcon"], "falcon"),
    (["yi"], "yi"),
    (["baichuan"], "baichuan"),
    (["internlm"], "internlm2"),
]
DEFAULT_TEMPLATE = "qwen3"

TOKENIZER_BY_TYPE = {
    "qwen2": "Qwen2TokenizerFast",
    "qwen3": "Qwen2TokenizerFast",
    "qwen2_vl": "Qwen2TokenizerFast",
    "qwen2_audio": "Qwen2TokenizerFast",
    "llama": "LlamaTokenizerFast",
    "mistral": "LlamaTokenizerFast",
    "falcon": "LlamaTokenizerFast",
    "deepseek": "LlamaTokenizerFast",
    "deepseek_v2": "LlamaTokenizerFast",
    "deepseek_v3": "LlamaTokenizerFast",
    "gpt2": "GPT2TokenizerFast",
    "gpt_bigcode": "GPT2TokenizerFast",
}

# --- training logs ----------------------------------------------------------
METRIC_FIELDS = ["loss", "grad_norm", "learning_rate", "epoch"]
METRICS_PATTERN = r"'loss'\s*:"
TOTAL_STEPS_PATTERN = r"Total optimization steps\s*=\s*(\d+)"
CHECKPOINT_PATTERN = r"checkpoint-(\d+)"
PATIENCE_LIMIT = 30
MARGIN_FLOOR = 0.02
MARGIN_SHARE = 0.05

# --- chat text --------------------------------------------------------------
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
BPE_NEWLINE = "Ċ"
BPE_SPACE = "Ġ"
CLEAR_COMMAND = "/clear"
QUIT_COMMANDS = ["/quit", "/exit"]

# --- run configs, state, history --------------------------------------------
CONFIG_DEFAULTS = {
    "stage": "sft",
    "finetuning_type": "lora",
    "cutoff_len": "512",
    "max_samples": "10000",
    "per_device_train_batch_size": "2",
    "gradient_accumulation_steps": "8",
    "learning_rate": "0.0001",
    "lr_scheduler_type": "cosine",
    "warmup_ratio": "0.1",
    "bf16": "true",
    "logging_steps": "5",
    "save_steps": "100",
    "plot_loss": "true",
    "overwrite_output_dir": "true",
    "report_to": "none",
    "trust_remote_code": "true",
    "do_train": "true",
}
LORA_DEFAULTS = {"lora_rank": "8", "lora_dropout": "0.05", "lora_target": "all"}
TARGET_LOSS_STEPS = {"save_steps": "1", "logging_steps": "1"}
SAMPLE_CAP = 10000

STATE_DEFAULTS = {
    "active_model": "",
    "active_adapter": "",
    "active_template": "qwen3",
    "active_dataset": "",
    "theme": "dark",
    "training_history": "[]",
}
HISTORY_FIELDS = [
    "name", "output_name", "model", "adapter", "template",
    "dataset", "stage", "epochs", "config", "timestamp",
]

# --- workspace --------------------------------------------------------------
WORKSPACE_DIRS = ["data", "yaml", "saves", "models", "configs"]
READINESS_BANDS = [(1000, "quality"), (100, "usable"), (10, "sanity"), (0, "too small")]
