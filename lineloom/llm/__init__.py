"""Training-data operators: quality, sharding, licences, decontamination, packing, search, toxicity, dedup, secrets, chat.

Nothing outside this package imports it.  Each module holds one operator; ``entries`` registers the
thin ``opN_<name>`` queries that apply them to whole tables.
"""
