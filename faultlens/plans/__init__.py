"""faultlens.plans"""
