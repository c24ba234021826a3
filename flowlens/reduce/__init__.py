"""Feature reducers."""


def model_class(kind: str):
    """Model type of a saved run."""
    from flowlens.reduce.linear import LinearModel, MdsModel
    from flowlens.reduce.nets import NetModel

    return {"pca": LinearModel, "lda": LinearModel, "mds": MdsModel}.get(kind, NetModel)
