"""DataFrame -> DataFrame operators: staging, quality, touches, attribution,
influence, funnel, LTV/CAC."""
