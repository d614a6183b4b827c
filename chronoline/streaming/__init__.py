"""Stateless stages on a stream.

There is no streaming operator to rebuild. Projections, cleaning and joins
with static tables accept a streaming frame as they are; the function below
names the chain that a stream of new records goes through.
"""

from chronoline.streaming.stateless import clean_stream

__all__ = ["clean_stream"]
