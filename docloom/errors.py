"""Errors of the engine. Each name tells the rule that was broken."""

from __future__ import annotations


class DocumentError(Exception):
    """Any error of this engine."""


class QueryError(DocumentError):
    """A query document that can't be read."""


class CursorError(QueryError):
    """A cursor that can't be read or no longer fits."""


class UpdateError(DocumentError):
    """An update program that can't be read or applied."""


class StoreError(DocumentError):
    """A bucket, transaction, index or change feed that can't do what is asked."""


def _family(base: type[DocumentError], names: str) -> dict[str, type[DocumentError]]:
    return {n: type(n, (base,), {"__module__": __name__}) for n in names.split()}


# Names of conditions.
globals().update(
    _family(
        QueryError,
        "InvalidQueryRoot InvalidQueryFilter InvalidQueryPath InvalidQueryOperator InvalidQueryOperatorParameter "
        "InvalidQueryOperatorBetweenSize InvalidInOperatorValue InvalidQuerySort InvalidQuerySortParamLength "
        "InvalidQuerySortParamType InvalidQuerySector InvalidQueryOffset OffsetValueNegative LimitValueNegative "
        "InvalidQueryProjection InvalidQueryProjectionValue InvalidQueryProjectionPath UnsupportedType",
    )
    | _family(
        CursorError,
        "InvalidCursor InvalidCursorVersion InvalidCursorMode MissingCursorIndexPath InvalidCursorAnchor InvalidCursorDocId UnsupportedCursorQuery",
    )
    | _family(
        UpdateError,
        "InvalidUpdateProgram InvalidUpdateStage InvalidUpdateValue InvalidUpdateOperator InvalidUpdatePath InvalidExpression "
        "InvalidExpressionArgument InvalidExpressionArgumentCount InvalidDateTime IntegerOverflow",
    )
    | _family(
        StoreError,
        "DuplicateKey IndexNotFound TransactionActive InvalidTransaction IteratorDrained WalNotActive OplogGap ReplicationGap InvalidFormat InvalidDocument KeyTooLong",
    )
)

