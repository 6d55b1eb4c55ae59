"""Operators for preparing training data: quality, near-duplicates, decontamination,
mixing, token files, licences, chat, classification, extraction, personal data."""
