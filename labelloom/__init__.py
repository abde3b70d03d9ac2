"""labelloom: Spark jobs for text classification under a changing label taxonomy.

Relabel a corpus through versioned mappings, sample new labels, train and score
distributed classifiers, and judge predictions, all as DataFrame transformations.
"""
