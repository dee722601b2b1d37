"""Streams of detections.

Column macros and the delay filter apply to streams as they are; anchored sessions keep one anchor per key as state.
"""
