"""Scoring needs no streaming code of its own.

``SubspaceModel.transform`` is a map-only plan without actions or shuffles, so it accepts a frame from
``readStream`` as it is. Fitting is a batch job; nothing here keeps state over a stream.
"""
