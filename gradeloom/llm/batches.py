"""The bounded batches of ``gradeloom.batches``, which the operators share."""

from gradeloom.batches import BATCH_BYTES, bounded_batches, give_back

__all__ = ["BATCH_BYTES", "bounded_batches", "give_back"]
