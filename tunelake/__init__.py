"""tunelake: the data work around fine-tuning language models, as Spark jobs."""
