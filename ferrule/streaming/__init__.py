"""No operator here works on streams: a factorization needs its whole matrix. The package stays empty on purpose."""
