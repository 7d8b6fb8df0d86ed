"""Operators for building training data from text records.

The library's own text record is the OCR transcript: one row per video with
``video_id``, ``ocr_text`` (everything read in its frames, one line per board) and
``channel`` (the site that published it). The operators take these names as
defaults. Nothing outside this subpackage imports it.
"""
