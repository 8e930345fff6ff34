"""Preparing, checking and sending collections of documents to translation services, as DataFrame operators."""
