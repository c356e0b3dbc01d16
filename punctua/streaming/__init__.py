"""Row-wise operators on a stream.

There is no stateful streaming operator in this engine. Labelling is row-wise, so it runs
unchanged on a streaming DataFrame; the gates of ``check`` need a finished table.
"""
from punctua.operators.prepare import prepare_rows as label_stream  # noqa: F401
