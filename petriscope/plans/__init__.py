"""The verbs - process, profile, measure, embed, convert - composed from sources and operators."""
