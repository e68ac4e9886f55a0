"""Schemas of the tables that a run reads and writes, as DDL."""

SAMPLES = "sample_id long, sample_idx long, question string, answer_gt string, dataset string, language string, answer_type string"
MODELS = "model_name string, n_layers int, hidden_dim int, vocab_size int, model_type string"
GENERATIONS = (
    "model string, dataset string, language string, sample_id long, prompt_length int, generated_token_ids array<int>, "
    "generated_text string, terminators array<int>, max_new_tokens int, error string"
)
METADATA = (
    "sample_id long, dataset string, language string, model string, question string, answer_gt string, answer_type string, "
    "is_correct boolean, answer_token_count int, finish_reason string, generated_length int, prompt_length int, extracted_answer string"
)
OUTPUTS = "sample_id long, prompt string, generated_text string, extracted_answer string, max_probability double, perplexity double, entropy double"
STEP_LOGITS = "sample_id long, step int, logits array<float>"
TOKEN_STATES = "sample_idx long, token_idx int, layer int, vec array<float>"
LAYER_STATES = "sample_idx long, layer int, vec array<float>"
SAMPLE_STATUS = "sample_idx long, sample_id long, valid boolean"
RUN_STATS = "run_id string, model string, dataset string, n_samples long, n_processed long, n_correct long, n_errors long, accuracy double"
#: What keys a sample's rows within a run.
SAMPLE_KEY = ["model", "dataset", "language", "sample_id"]
