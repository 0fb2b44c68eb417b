from tallyframe.functions.numbers import numeric
from tallyframe.functions.text import split_tokens, suffix_window, title_year
from tallyframe.functions.times import epoch_seconds, epoch_year
from tallyframe.functions.vectors import cross_entropy_loss, scale_vector, softmax

__all__ = [
    "cross_entropy_loss",
    "epoch_seconds",
    "epoch_year",
    "numeric",
    "scale_vector",
    "softmax",
    "split_tokens",
    "suffix_window",
    "title_year",
]
