"""The library's names in one place."""

from parlance.functions.align import cer, lcs_length, token_edit_distance, wer
from parlance.functions.sql import register, scored_view
from parlance.functions.text import explained, normalized, postprocessed, tokens
from parlance.operators.agreement import confusion_matrix, item_agreement, kappa, percent_agreement, protocol_agreement, report, score_difference_stats
from parlance.operators.audio import Audio, preprocess, segments, trimmed
from parlance.operators.ensemble import score_pairs
from parlance.operators.evaluation import compare, compare_by_position, evaluate, word_error_rate
from parlance.operators.rubric import Rubric
from parlance.operators.transcripts import merge_segments, postprocess, transcribe, with_references
from parlance.streaming.scoring import score_stream, windowed_agreement

__all__ = [
    *("Audio", "Rubric", "cer", "compare", "compare_by_position", "confusion_matrix", "evaluate", "explained", "item_agreement", "kappa"),
    *("lcs_length", "merge_segments", "normalized", "percent_agreement", "postprocess", "postprocessed", "preprocess", "protocol_agreement"),
    *("register", "report", "score_difference_stats", "score_pairs", "score_stream", "scored_view", "segments", "token_edit_distance", "tokens"),
    *("transcribe", "trimmed", "wer", "windowed_agreement", "with_references", "word_error_rate"),
]
