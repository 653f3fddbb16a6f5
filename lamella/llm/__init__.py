"""Training-data operators: curation steps over the document tables.

Nothing outside this folder imports it; the folder can be deleted as a whole.
"""
