"""Training-data operators: tokenizers, language identification, language-model
scores, toxicity, secrets, near-duplicates, decontamination and substring
deduplication.  Nothing outside this subpackage imports it."""
